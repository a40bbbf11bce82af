"""Descriptive statistics against numpy on whole columns."""

import numpy as np
import pandas as pd
import pytest

from tabprep.operators import describe


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame({
        "row_id": np.arange(n),
        "cont": rng.normal(size=n),
        "ties": rng.integers(0, 5, size=n).astype(float),
        # a third of all rows share one value, plus a far outlier
        "skew": np.where(np.arange(n) % 3 == 0, 42.0, rng.exponential(size=n)),
        "const": np.full(n, 2.5),
    })
    pdf.loc[7, "skew"] = 1e9
    pdf.loc[11, "cont"] = np.nan
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("buckets,fetch,table", [(4096, 100_000, 262_144), (4, 3, 262_144),
                                                (4096, 40, 8)])
def test_exact_quantiles(frame, monkeypatch, buckets, fetch, table):
    """Exact against numpy, also when the per-pass budgets (bucket table,
    fetched pairs) force more refinement passes."""
    df, pdf = frame
    monkeypatch.setattr(describe, "BUCKETS", buckets)
    monkeypatch.setattr(describe, "FETCH_ROWS", fetch)
    monkeypatch.setattr(describe, "TABLE_ROWS", table)
    cols = ["cont", "ties", "skew", "const"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = describe.exact_quantiles(df, cols, probs)
    for c in cols:
        x = pdf[c].dropna().to_numpy()
        assert got[c] == pytest.approx(list(np.quantile(x, probs)), rel=1e-12, abs=1e-12)


def test_histogram_matches_numpy(frame):
    df, pdf = frame
    h = describe.histogram(df, ["cont", "ties", "const"], 30).toPandas()
    for c in ["cont", "ties", "const"]:
        counts, _ = np.histogram(pdf[c].dropna(), bins=30)
        got = h[h.feature == c].sort_values("bin")["n"].to_numpy()
        assert list(got) == list(counts)


def test_box_and_describe(frame):
    df, pdf = frame
    b = describe.box_stats(df, ["skew"]).first()
    x = pdf["skew"].to_numpy()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    iqr = q3 - q1
    assert b["hi_whisker"] == x[x <= q3 + 1.5 * iqr].max()
    assert b["n_out"] == int(((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).sum())
    d = describe.describe_table(df, ["cont"]).first()
    assert d["count"] == 4999
    assert d["std"] == pytest.approx(pdf["cont"].std())
    assert d["q50"] == pytest.approx(pdf["cont"].median())


def test_correlation_constant_is_null(frame):
    df, pdf = frame
    m = {(r["a"], r["b"]): r["r"] for r in describe.correlation_matrix(df, ["cont", "ties", "const"]).collect()}
    assert m[("cont", "const")] is None
    assert m[("cont", "cont")] == pytest.approx(1.0)
    assert m[("cont", "ties")] == pytest.approx(pdf[["cont", "ties"]].corr().iloc[0, 1])


def test_density_integrates_to_one(frame):
    df, _ = frame
    d = describe.density(df, ["cont", "const"]).toPandas()
    assert set(d.feature) == {"cont"}                    # zero spread: no curve
    d = d.sort_values("i")
    area = np.trapezoid(d.density, d.x)
    assert area == pytest.approx(1.0, abs=1e-3)
