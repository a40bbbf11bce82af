"""NULL, NaN and infinite values: one notion of missing, and no endless passes."""

import math

import numpy as np
import pytest

from tabprep.operators import cleaning, describe, filters, hypothesis, models, projection
from tabprep.splits import Splits

NAN, INF = float("nan"), float("inf")


def test_one_nan_flags_no_other_row(spark):
    rows = [(i, float(i % 5), 0.0) for i in range(20)] + [(20, NAN, 0.0), (21, None, 0.0)]
    df = spark.createDataFrame(rows, "row_id long, x double, arr_delay double")
    flags = {r.row_id: r.is_outlier for r in cleaning.outlier_flags(df, ["x"], 2.0).collect()}
    assert not any(flags.values())
    kept = cleaning.remove_outliers(Splits(df, df), 2.0, ["x"])
    assert kept.train.count() == 22
    far = df.unionByName(spark.createDataFrame([(22, 1000.0, 0.0)], df.schema))
    assert [r.row_id for r in cleaning.outlier_flags(far, ["x"], 2.0).where("is_outlier").collect()] == [22]


def test_nan_is_missing_in_counts_fills_and_classes(spark):
    df = spark.createDataFrame([(1, NAN, "a"), (2, 3.0, "a"), (3, None, None), (4, 5.0, "b")],
                               "row_id long, x double, c string")
    assert {r["column"]: r.n_null for r in cleaning.null_counts(df).collect()} == {"row_id": 0, "x": 2, "c": 1}
    assert cleaning.fit_fill_values(df, "mean", ["x"]) == {"x": 4.0}
    filled = cleaning.apply_fill_values(df, {"x": 4.0})
    assert [r.x for r in filled.orderBy("row_id").collect()] == [4.0, 3.0, 4.0, 5.0]
    assert df.where(filters.positive_class("x")).count() == 2
    assert filters.binary_label(df, "x", 4).where("label_binary = 1").count() == 1


def test_fill_keeps_large_integers_and_rejects_fractions(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, big), (2, big), (3, None)], "row_id long, x long")
    filled = cleaning.fill_missing(Splits(df, df), "most_frequent", cols=["x"]).train
    assert [r.x for r in filled.orderBy("row_id").collect()] == [big] * 3
    with pytest.raises(ValueError):
        cleaning.fit_fill_values(df, "constant", ["x"], 5.7)


def test_tests_drop_nan_targets(spark):
    rng = np.random.default_rng(4)
    clean = [(int(i % 3), float(v)) for i, v in enumerate(rng.normal(size=90))]
    schema = "g int, y double"
    a = spark.createDataFrame(clean, schema)
    b = spark.createDataFrame(clean + [(0, NAN), (1, None), (2, NAN)], schema)
    ka, kb = (hypothesis.kruskal(d, ["g"], "y").first() for d in (a, b))
    assert (ka["n"], ka["statistic"]) == (kb["n"], kb["statistic"])
    two = [(g, y) for g, y in clean if g < 2]
    wa, wb = (hypothesis.welch_t(spark.createDataFrame(r, schema), ["g"], "y").first()
              for r in (two, [*two, (0, NAN)]))
    assert wa["statistic"] == pytest.approx(wb["statistic"], rel=1e-12) and wb["status"] == "ok"


def test_battery_reports_features_without_a_class(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (None, 3, 3.0)],
                               "is_weekend int, season int, arr_delay double")
    rows = {r.feature: r for r in hypothesis.run_tests(df).collect()}
    assert rows["is_weekend"].status.startswith("skipped") and rows["is_weekend"].n_classes == 0
    assert rows["season"].n_classes == 3


def test_quantiles_end_with_infinite_values(spark, monkeypatch):
    monkeypatch.setattr(describe, "FETCH_ROWS", 50)
    values = [float(v) for v in range(397)] + [INF, -INF, INF]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = describe.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    want = np.quantile(np.array(sorted(values)), [0.25, 0.5, 0.75])
    assert got[1:4] == pytest.approx(list(want))
    assert got[0] == -INF and got[4] == INF
    wide = spark.createDataFrame([(1e308,), (-1e308,), (0.0,), (1.0,)] * 30, "x double")
    assert describe.exact_quantiles(wide, ["x"], [0.5])["x"][0] == pytest.approx(0.5)


def test_histogram_of_columns_without_values(spark):
    df = spark.createDataFrame([(None, INF), (None, INF)], "a double, b double")
    assert describe.histogram(df, ["a", "b"]).count() == 0


def test_r2_keeps_its_digits_far_from_zero(spark):
    rows = [(float(i % 7), float(i % 7) + 0.2 * (-1) ** i) for i in range(700)]
    want = models.r2_score(spark.createDataFrame(rows, "y double, _pred double"), "y").first()["r2"]
    far = [(y + 1e8, p + 1e8) for y, p in rows]
    assert models.r2_score(spark.createDataFrame(far, "y double, _pred double"), "y").first()["r2"] == pytest.approx(
        want, abs=1e-6)


def test_knn_leaves_out_rows_with_a_missing_coordinate(spark):
    rng = np.random.default_rng(7)
    pts = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    schema = "row_id long, v array<double>"
    clean = {(r.src, r.dst) for r in projection.knn_graph(spark.createDataFrame(pts, schema), "v", 3,
                                                          n_pivots=4).collect()}
    dirty = spark.createDataFrame(pts + [(900, [None, 1.0]), (901, [NAN, 0.0])], schema)
    assert {(r.src, r.dst) for r in projection.knn_graph(dirty, "v", 3, n_pivots=4).collect()} == clean


def test_importance_finds_the_signal_and_not_the_constant(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 1.0, 1e8 + 10 * float(a)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double")
    model = models.fit_forest(df, ["a", "b", "c"], "y", max_depth=6)
    imp = {r.feature: r.importance_mean for r in
           models.permutation_importance(model, df, ["a", "b", "c"], "y").collect()}
    assert imp["a"] > 0.5 and abs(imp["c"]) < 1e-9 and imp["a"] > 10 * abs(imp["b"])
    assert all(math.isfinite(v) for v in imp.values())
