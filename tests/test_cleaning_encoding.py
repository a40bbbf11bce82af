"""Duplicates, missing values, outliers, label codes and scaling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.errors import UnknownStrategyError
from tabprep.operators import cleaning, encoding
from tabprep.splits import Splits


def test_dedup_keeps_lowest_key_and_nulls_equal(spark):
    df = spark.createDataFrame(
        [(5, "a", None, 1.0), (2, "a", None, 2.0), (3, "b", 1, 3.0), (9, "b", 1, 4.0), (1, "c", 2, 5.0)],
        "row_id long, f string, g int, y double")
    out = {r["row_id"]: r["y"] for r in cleaning.drop_duplicate_rows(df, label="y").collect()}
    assert out == {2: 2.0, 3: 3.0, 1: 5.0}


def test_dedup_hot_group(spark):
    # a third of the rows in one duplicate group collapse map-side
    df = spark.range(0, 3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("f"))
    out = cleaning.drop_duplicate_rows(df)
    assert out.count() == 2000          # id 7 also has f = 7
    assert out.where("f = 7").first()["row_id"] == 0


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 3.0, None), (3, None, None)],
                               "row_id long, a double, b string")
    got = dict(cleaning.null_counts(df).collect())
    assert got == {"row_id": 0, "a": 2, "b": 2}


def _splits(spark):
    tr = spark.createDataFrame([(1, 1.0, "x", 0.5), (2, None, "x", 0.5), (3, 3.0, "y", 0.5),
                                (4, 4.0, None, 0.5)], "row_id long, a double, s string, arr_delay double")
    te = spark.createDataFrame([(10, None, None, 1.0), (11, 10.0, "z", 1.0)],
                               "row_id long, a double, s string, arr_delay double")
    return Splits(tr, te)


def test_fill_strategies(spark):
    s = _splits(spark)
    mean = cleaning.fill_missing(s, "mean")
    assert dict(mean.train.select("row_id", "a").collect())[2] == pytest.approx(8 / 3)
    assert dict(mean.test.select("row_id", "a").collect())[10] == 10.0        # own split
    tmean = cleaning.fill_missing(s, "mean", fit_on="train")
    assert dict(tmean.test.select("row_id", "a").collect())[10] == pytest.approx(8 / 3)
    med = cleaning.fill_missing(s, "median")
    assert dict(med.train.select("row_id", "a").collect())[2] == 3.0
    mf = cleaning.fill_missing(s, "most_frequent")
    assert dict(mf.train.select("row_id", "s").collect())[4] == "x"
    assert dict(mf.train.select("row_id", "a").collect())[2] == 1.0         # tie -> smallest
    const = cleaning.fill_missing(s, "constant", value="?")
    assert dict(const.train.select("row_id", "s").collect())[4] == "?"
    assert dict(const.train.select("row_id", "a").collect())[2] is None      # type-checked
    drop = cleaning.fill_missing(s, "drop")
    assert sorted(r[0] for r in drop.train.select("row_id").collect()) == [1, 3]
    with pytest.raises(UnknownStrategyError):
        cleaning.fill_missing(s, "fill_nan")


def test_outliers_constant_column_never_flags(spark):
    rows = [(i, 5.0, float(i)) for i in range(20)] + [(99, 5.0, 1000.0)]
    df = spark.createDataFrame(rows, "row_id long, const double, x double")
    flags = dict(cleaning.outlier_flags(df, ["const", "x"], 2.0).select("row_id", "is_outlier").collect())
    assert flags[99] is True
    assert sum(flags.values()) == 1
    out = cleaning.remove_outliers(Splits(df, df), 2.0, ["const", "x"], label=None)
    assert out.train.count() == 20 and out.test.count() == 21


def test_label_codes_numeric_order_and_roundtrip(spark):
    tr = spark.createDataFrame([(1, 10, "b"), (2, 2, "a")], "row_id long, m int, s string")
    te = spark.createDataFrame([(3, 1, "c")], "row_id long, m int, s string")
    codes = encoding.fit_label_encoder(Splits(tr, te), ["m", "s"])
    got = {(r["column"], r["value"]): r["code"] for r in codes.codes.collect()}
    assert got[("m", "1")] == 0 and got[("m", "2")] == 1 and got[("m", "10")] == 2
    enc = encoding.apply_label_encoder(tr, codes, ["m", "s"])
    assert dict(enc.select("row_id", "m").collect()) == {1: 2, 2: 1}
    back = encoding.decode_labels(enc, codes, ["m", "s"])
    assert dict(back.select("row_id", "s").collect()) == {1: "b", 2: "a"}


def test_a_code_is_looked_up_once_a_row(spark):
    tr = spark.createDataFrame([(1, 10, "b"), (2, 2, "a"), (3, None, None)], "row_id long, m int, s string")
    codes = encoding.fit_label_encoder(Splits(tr, tr), ["m", "s"])
    enc = encoding.apply_label_encoder(tr, codes, ["m", "s"])
    out = encoding.apply_affine(enc, [{"column": c, "mean": 0.5, "scale": 2.0} for c in ("m", "s")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_error(") == 2               # a mention of a column's code is a look-up
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0.25, 0.25), (2, -0.25, -0.25), (3, None, None)]
    new = spark.createDataFrame([(4, 11, "a")], "row_id long, m int, s string")
    with pytest.raises(Exception, match="unseen label in column m"):
        encoding.apply_label_encoder(new, codes, ["m", "s"]).collect()


def test_scalers(spark):
    tr = spark.createDataFrame([(1, 1.0, 3), (2, 2.0, 3), (3, 6.0, 3)], "row_id long, x double, c int")
    std = encoding.fit_standard(tr, ["x"])
    mm = encoding.fit_minmax(tr, ["c"])
    out = encoding.apply_affine(encoding.apply_affine(tr, std), mm).toPandas()
    assert out["x"].mean() == pytest.approx(0.0, abs=1e-12)
    assert np.std(out["x"]) == pytest.approx(1.0)                     # population std
    assert list(out["c"]) == [0.0, 0.0, 0.0]                          # zero range -> 0
