"""H1-H4: Welch t-tests and Kruskal-Wallis tests of a continuous target
across the classes of categorical features.

Both tests reduce the data to small aggregated tables before any shuffle of
consequence:

- Welch: ``(feature, class) -> count, mean, sample variance`` from one grouped
  aggregate over the features stacked as ``(feature, class, y)``.
- Kruskal-Wallis: ``(feature, class, y) -> count``; midranks come from the
  per-value counts (``rank = values below + (ties + 1) / 2``), computed as an
  ordered prefix sum over the *distinct* target values, range-partitioned so
  that no single task sees every value. Rank sums per class are then a join of two aggregated tables - the rows are never
  ranked one by one, and heavy ties (half the targets are 0 after balancing)
  collapse into single values.

Statistics, degrees of freedom and p-values (:mod:`tabprep.functions.tails`) are
column expressions over the handful of result rows.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions import tails
from tabprep.functions.missing import present
from tabprep.operators import filters
from tabprep.operators.ranges import ordered_prefix_sum
from tabprep.session import materialize


RESULT = ["feature", "test", "n_classes", "n", "statistic", "df"]


def stacked_classes(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """H4 + stacking: ``feature, cls, cls_num, y`` for rows with a target and a
    class (NULL and NaN are neither). ``cls`` is the class as text; ``cls_num``
    orders numeric classes numerically (NULL for text classes, ordered as text)."""
    from tabprep.operators.filters import NUMERIC_TYPES

    types = {f.name: f.dataType for f in df.schema.fields}
    structs = [F.struct(F.lit(f).alias("feature"), present(f, types[f]).cast("string").alias("cls"),
                        (present(f, types[f]).cast("double") if isinstance(types[f], NUMERIC_TYPES)
                         else F.lit(None).cast("double")).alias("cls_num"))
               for f in features]
    y = present(F.col(label).cast("double"))
    return (df.where(y.isNotNull()).select(y.alias("y"), F.inline(F.array(*structs)))
            .where(F.col("cls").isNotNull()))


def class_stats(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """A7 for many features: ``feature, cls, n, mean, var`` (sample variance)."""
    return (stacked_classes(df, features, label).groupBy("feature", "cls_num", "cls")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"),
                 F.var_samp("y").alias("var")))


def welch_table(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """H1 without p: ``feature, n_classes, n1, n2, statistic, df`` - class 1
    is the smaller class value, so ``statistic`` is mean(1) - mean(2) scaled.
    Features without exactly two classes get NULL statistics."""
    cs = class_stats(df, features, label)
    w = Window.partitionBy("feature").orderBy(F.col("cls_num").asc_nulls_last(), "cls")
    ranked = (cs.withColumn("ci", F.row_number().over(w))
              .withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("feature"))))
    g1 = ranked.where("ci = 1").select("feature", "k", F.col("n").alias("n1"),
                                       F.col("mean").alias("m1"), F.col("var").alias("v1"))
    g2 = ranked.where("ci = 2").select("feature", F.col("n").alias("n2"),
                                       F.col("mean").alias("m2"), F.col("var").alias("v2"))
    j = g1.join(g2, "feature", "left")
    binary = F.col("k") == 2
    s1 = F.col("v1") / F.col("n1")
    s2 = F.col("v2") / F.col("n2")
    se2 = s1 + s2
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.try_divide(s1 * s1, F.col("n1") - 1)
                       + F.try_divide(s2 * s2, F.col("n2") - 1))
    return j.select(
        "feature", F.col("k").cast("int").alias("n_classes"),
        F.when(binary, F.col("n1")).cast("bigint").alias("n1"),
        F.when(binary, F.col("n2")).cast("bigint").alias("n2"),
        F.when(binary, t).alias("statistic"), F.when(binary, dof).alias("df"))


def welch_t(df: DataFrame, features: Sequence[str] | str, label: str,
            alpha: float = 0.05) -> DataFrame:
    """H1: ``feature, test, n_classes, n, statistic, df, p_value, log10_p, significant,
    status`` (the logarithm also where p is below the smallest double)."""
    feats = [features] if isinstance(features, str) else list(features)
    wt = welch_table(df, feats, label)
    ln_p = tails.ln_t_two_sided(F.col("statistic"), F.col("df"))
    return wt.select(
        "feature", F.lit("welch_t").alias("test"), "n_classes",
        (F.col("n1") + F.col("n2")).cast("bigint").alias("n"), "statistic", "df", ln_p.alias("_ln")).select(
        *RESULT, F.exp("_ln").alias("p_value"), (F.col("_ln") / math.log(10)).alias("log10_p")).select(
        "*", F.coalesce(F.col("p_value") < F.lit(alpha), F.lit(False)).alias("significant"),
        F.when(F.col("n_classes") != 2, F.lit("skipped: not binary"))
         .when(F.col("statistic").isNull(), F.lit("undefined"))
         .otherwise(F.lit("ok")).alias("status"))


def kruskal_table(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """H2 without p: ``feature, n_classes, n, statistic, df`` - H with the
    tie correction; NULL when all targets are equal or fewer than 3 classes."""
    counts = materialize(stacked_classes(df, features, label).groupBy("feature", "cls", "y")
                         .agg(F.count(F.lit(1)).alias("n")), "class-values")
    vc = counts.groupBy("feature", "y").agg(F.sum("n").alias("t"))
    ranks = ordered_prefix_sum(vc, ["feature"], ["y"], "t").withColumn(
        "midrank", F.col("before") + (F.col("t") + F.lit(1)) / F.lit(2.0))
    per_feature = vc.groupBy("feature").agg(
        F.sum("t").cast("double").alias("N"),
        F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    per_class = (counts.join(ranks.select("feature", "y", "midrank"), ["feature", "y"])
                 .groupBy("feature", "cls")
                 .agg(F.sum(F.col("n") * F.col("midrank")).alias("R"),
                      F.sum("n").alias("ni")))
    # centred: the mean ranks' deviations from (N + 1) / 2 keep their digits
    off = F.col("R") / F.col("ni") - (F.col("N") + 1) / 2
    agg = per_class.join(F.broadcast(per_feature), "feature").groupBy("feature", "N", "ties").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("ni") * off * off).alias("sr"))
    j = agg
    n = F.col("N")
    h0 = F.lit(12.0) / (n * (n + 1)) * F.col("sr")
    corr = F.lit(1.0) - F.try_divide(F.col("ties"), n * n * n - n)
    h = F.when(corr > 0, h0 / corr)
    multi = F.col("k") > 2
    return j.select("feature", F.col("k").cast("int").alias("n_classes"),
                    n.cast("bigint").alias("n"),
                    F.when(multi, h).alias("statistic"),
                    F.when(multi, F.col("k") - 1).cast("int").alias("df"))


def kruskal(df: DataFrame, features: Sequence[str] | str, label: str,
            alpha: float = 0.05) -> DataFrame:
    """H2: ``feature, test, n_classes, n, statistic, df, p_value, log10_p, significant,
    status`` (p from the chi-square tail with k - 1 df)."""
    feats = [features] if isinstance(features, str) else list(features)
    kt = kruskal_table(df, feats, label)
    ln_p = tails.ln_chi2_tail(F.col("statistic"), F.col("df"))
    return kt.select(
        "feature", F.lit("kruskal").alias("test"), "n_classes", "n", "statistic",
        F.col("df").cast("double").alias("df"), ln_p.alias("_ln")).select(
        *RESULT, F.exp("_ln").alias("p_value"), (F.col("_ln") / math.log(10)).alias("log10_p")).select(
        "*", F.coalesce(F.col("p_value") < F.lit(alpha), F.lit(False)).alias("significant"),
        F.when(F.col("n_classes") <= 2, F.lit("skipped: needs 3+ categories"))
         .when(F.col("statistic").isNull(), F.lit("undefined"))
         .otherwise(F.lit("ok")).alias("status"))


# The features each test is run on.
BINARY_FEATURES = ["is_weekend", "is_holiday_month"]
MULTICLASS_FEATURES = ["time_of_day", "season", "flight_type", "day_of_week", "month"]


def _with_all(tests: DataFrame, features: Sequence[str], test: str, status: str) -> DataFrame:
    """One row per asked feature: those without any class are skipped rows."""
    asked = tests.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return asked.join(tests, "feature", "left").select(
        "feature", F.lit(test).alias("test"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"), "n", "statistic",
        "df", "p_value", "log10_p", F.coalesce("significant", F.lit(False)).alias("significant"),
        F.coalesce("status", F.lit(status)).alias("status"))


def run_tests(df: DataFrame, label: str = "arr_delay",
              binary: Sequence[str] = BINARY_FEATURES,
              multi: Sequence[str] = MULTICLASS_FEATURES, alpha: float = 0.05) -> DataFrame:
    """H3: Welch on the binary features, Kruskal-Wallis on the multi-class
    ones, skipping absent columns; one row per tested feature."""
    b, m = filters.existing(df, binary), filters.existing(df, multi)
    parts = []
    if b:
        parts.append(_with_all(welch_t(df, b, label, alpha), b, "welch_t", "skipped: not binary"))
    if m:
        parts.append(_with_all(kruskal(df, m, label, alpha), m, "kruskal", "skipped: needs 3+ categories"))
    if not parts:
        raise ValueError("none of the requested features is present")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
