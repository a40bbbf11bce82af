"""Tail probabilities of the tests as column expressions (no UDF, nothing to ship).

- Student t: ``P(|T| > t) = I_{df/(df+t^2)}(df/2, 1/2)``, the regularised incomplete
  beta function by its continued fraction (DLMF 8.17.22).
- Chi-square: ``P(X > x) = Q(k/2, x/2)``, the regularised upper incomplete gamma
  function by its power series (DLMF 8.7.1) or continued fraction (DLMF 8.9.2).

Fractions and series are folds (``aggregate`` over a sequence as long as the argument
needs). Log-gamma is Stirling's series (DLMF 5.11.1) after a shift by the recurrence.
Everything is kept as natural logarithms up to the end, so tails below the smallest
double still have their logarithm. For very many degrees of freedom the t tail is
the normal one of the expansion of t in 1/df. These run over the few result rows (one
per tested feature), never over data rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a zero in a fraction's recurrence.
SMALLEST = 1e-300
#: How far log-gamma is shifted before its asymptotic series.
SHIFT = 20
#: Degrees of freedom from which the expansion around the normal tail is exact to double precision.
NORMAL_DF = 1e6


def _nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(SMALLEST)).otherwise(c)


def _steps(n: Column) -> Column:
    return F.sequence(F.lit(0), F.least(F.ceil(n), F.lit(200_000)).cast("int"))


def _shifted(a: Column, term) -> Column:
    """The sum of ``term(a + k)`` over the steps of the shift."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, k: s + term(a + k))


def ln_gamma(a: Column) -> Column:
    z = a + F.lit(SHIFT)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - _shifted(a, lambda x: F.ln(x))


def ln_half_step(a: Column) -> Column:
    """``ln Gamma(a + 1/2) - ln Gamma(a)`` by the series of the difference, where the
    difference of two large logarithms would lose digits."""
    z = a + F.lit(SHIFT)
    far = 0.5 * F.ln(z) - 1 / (8 * z) + 1 / (192 * z * z * z) - 1 / (640 * F.pow(z, F.lit(5.0))) + 17 / (14336 * F.pow(z, F.lit(7.0)))
    return far - _shifted(a, lambda x: F.log1p(F.lit(0.5) / x))


def ln_fraction(terms, n: Column) -> Column:
    """The logarithm of ``a0 / (b0 + a1 / (b1 + ...))`` with ``terms(k) = (a, b)``, ``n``
    terms, by the ratio recurrence of successive numerators and denominators."""
    def step(state, k):
        a, b = terms(k.cast("double"))
        lower = F.lit(1.0) / _nonzero(b + a * state["lower"])
        upper = _nonzero(b + a / state["upper"])
        return F.struct((state["value"] * (upper * lower)).alias("value"), upper.alias("upper"), lower.alias("lower"))
    start = F.struct(F.lit(SMALLEST).alias("value"), F.lit(SMALLEST).alias("upper"), F.lit(0.0).alias("lower"))
    return F.ln(F.aggregate(_steps(n), start, step, lambda s: s["value"]))


def _ln_beta_side(a: Column, b: Column, x: Column, other: Column, ln_beta: Column) -> Column:
    """``ln I_x(a, b)`` where its fraction converges fast; ``other`` is ``1 - x``."""
    def terms(k):
        m = F.floor((k - 1) / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))
        return F.when(k == 0, F.lit(1.0)).when(k % 2 == 1, odd).otherwise(even), F.lit(1.0)
    n = F.lit(80) + 8 * F.sqrt(F.greatest(a, b))
    return a * F.ln(x) + b * F.ln(other) - ln_beta - F.ln(a) + ln_fraction(terms, n)


def ln_t_two_sided(t: Column, df: Column) -> Column:
    """The logarithm of the two-sided p-value of a t statistic; NULL where either is
    NULL or NaN or there are no degrees of freedom."""
    t, df = F.abs(t.cast("double")), df.cast("double")
    a, b = df / 2, F.lit(0.5)
    x, y = df / (df + t * t), (t * t) / (df + t * t)
    ln_beta = F.lit(0.5 * math.log(math.pi)) - ln_half_step(a)
    direct = x * (a + b + 2.0) <= a + 1.0
    near = F.ln(F.lit(1.0) - F.exp(_ln_beta_side(b, a, y, x, ln_beta)))
    z = t - (F.pow(t, F.lit(3.0)) + t) / (4 * df) + (13 * F.pow(t, F.lit(5.0)) + 8 * F.pow(t, F.lit(3.0)) + 3 * t) / (96 * df * df)
    return (F.when(t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df) | (df <= 0), F.lit(None).cast("double"))
            .when(t == 0, F.lit(0.0)).when(t == float("inf"), F.lit(float("-inf")))
            .when((df >= NORMAL_DF) & (F.pow(t, F.lit(4.0)) < df), ln_gamma_tail(b, z * z / 2))
            .when(direct, _ln_beta_side(a, b, x, y, ln_beta)).otherwise(near))


def ln_gamma_tail(a: Column, x: Column) -> Column:
    """``ln Q(a, x)``, the regularised upper incomplete gamma function, for ``x >= 0``."""
    weight = a * F.ln(x) - x - ln_gamma(a)

    def terms(k):
        return F.when(k == 0, F.lit(1.0)).otherwise(k * (a - k)), x + 2 * k + 1.0 - a
    far = weight + ln_fraction(terms, F.lit(200) + 8 * F.sqrt(a))

    def step(state, k):
        term = state["term"] * x / (a + k.cast("double") + 1.0)
        return F.struct((state["total"] + term).alias("total"), term.alias("term"))
    start = F.struct((1.0 / a).alias("total"), (1.0 / a).alias("term"))
    series = F.aggregate(_steps(F.lit(100) + 12 * F.sqrt(a) + x), start, step, lambda s: s["total"])
    near = F.ln(F.greatest(F.lit(0.0), F.lit(1.0) - F.exp(weight) * series))
    return F.when(x == 0, F.lit(0.0)).when(x > a + 1.0, far).otherwise(near)


def ln_chi2_tail(x: Column, df: Column) -> Column:
    """The logarithm of the upper tail of the chi-square distribution; NULL where
    either is NULL or NaN or there are no degrees of freedom."""
    x, df = x.cast("double"), df.cast("double")
    return (F.when(x.isNull() | df.isNull() | F.isnan(x) | F.isnan(df) | (df <= 0), F.lit(None).cast("double"))
            .when(x <= 0, F.lit(0.0)).when(x == float("inf"), F.lit(float("-inf")))
            .otherwise(ln_gamma_tail(df / 2, x / 2)))
