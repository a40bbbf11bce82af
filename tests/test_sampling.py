"""hash_rank / prefixes against the window oracle; exact sizes."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabprep.operators import sampling

from .conftest import SF01


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_totalprice")


def window_rank(df, key, tag):
    h = sampling.hash_col(key, 42, tag)
    return df.withColumn("_wr", F.row_number().over(Window.orderBy(h, F.col(key))))


def test_hash_rank_equals_window(orders):
    ranked = sampling.hash_rank(orders, "o_orderkey", 42, "shuffle", out="r")
    joined = ranked.join(window_rank(orders, "o_orderkey", "shuffle").select("o_orderkey", "_wr"),
                         "o_orderkey")
    assert joined.where(F.col("r") != F.col("_wr")).count() == 0
    assert joined.count() == orders.count()


@pytest.mark.parametrize("n", [1, 7, 1000, 14999, 15000, 20000])
def test_sample_n_is_window_prefix(orders, n):
    s = sampling.sample_n(orders, n, "o_orderkey")
    expect = window_rank(orders, "o_orderkey", "sample").where(F.col("_wr") <= n)
    assert s.count() == min(n, orders.count())
    assert s.select("o_orderkey").subtract(expect.select("o_orderkey")).count() == 0


def test_prefix_multi_level_refinement(orders, monkeypatch):
    # tiny boundary groups force the 8-, 12-... digit refinement levels
    monkeypatch.setattr(sampling, "BOUNDARY_ROWS", 1)
    bound = sampling.prefix_bound(orders, 5000, "o_orderkey", 42, "sample", boundary_rows=1)
    s = orders.where(sampling._le_bound(sampling.hash_col("o_orderkey", 42, "sample"),
                                        F.col("o_orderkey"), bound[0], bound[1]))
    expect = window_rank(orders, "o_orderkey", "sample").where(F.col("_wr") <= 5000)
    assert s.count() == 5000
    assert s.select("o_orderkey").subtract(expect.select("o_orderkey")).count() == 0


def test_balance_and_split(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("row_id"),
                                     F.when(F.col("id") % 4 == 0, 5.0).otherwise(0.0).alias("y"))
    bal = sampling.balance_classes(df, "y", "row_id")
    counts = {r["pos"]: r["count"] for r in bal.groupBy((F.col("y") > 0).alias("pos")).count().collect()}
    assert counts == {True: 250, False: 250}
    sp = sampling.train_test_split(bal, 0.2, "row_id")
    assert sp.test.count() == math.ceil(0.2 * 500)
    assert sp.train.count() == 500 - 100
    assert sp.train.join(sp.test, "row_id").count() == 0


def test_balance_minority_zero_class(spark):
    # late flights in the majority: the zero class sets the size
    df = spark.range(0, 100).select(F.col("id").alias("row_id"),
                                    F.when(F.col("id") < 10, 0.0).otherwise(3.0).alias("y"))
    bal = sampling.balance_classes(df, "y", "row_id")
    assert bal.count() == 20


def test_balance_single_class_raises(spark):
    from tabprep.errors import SingleClassError
    df = spark.range(0, 10).select(F.col("id").alias("row_id"), F.lit(1.0).alias("y"))
    with pytest.raises(SingleClassError):
        sampling.balance_classes(df, "y", "row_id")


@pytest.mark.parametrize("boundary_rows,late_every", [(50_000, 4), (1, 4), (50_000, 2)])
def test_balance_superset_gives_the_same_rows(spark, monkeypatch, boundary_rows, late_every):
    """Balancing over the histogram superset (what the flight plan writes) keeps
    exactly the rows balancing over the whole table keeps - also when the
    boundary needs refinement levels, and when the classes are equal."""
    monkeypatch.setattr(sampling, "BOUNDARY_ROWS", boundary_rows)
    df = spark.range(0, 4000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % late_every == 0, 5.0).otherwise(0.0).alias("y"))
    counts, hist = sampling.class_prefix_counts(df, "y", "row_id", 42, "balance")
    direct = sampling.balance_classes(df, "y", "row_id", 42, counts=counts, hist=hist)
    sup = sampling.balance_superset(df, "y", "row_id", 42, counts, hist)
    via = sampling.balance_classes(sup, "y", "row_id", 42, counts=counts, hist=hist)
    a = {r["row_id"] for r in direct.select("row_id").collect()}
    b = {r["row_id"] for r in via.select("row_id").collect()}
    m = min(counts["pos"], counts["neg"])
    assert len(a) == 2 * m and a == b
    assert sup.count() >= len(a)


def test_boundary_prefix():
    hist = {"0001": 3, "00a0": 2, "ffff": 5}
    assert sampling.boundary_prefix(hist, 0) == ""
    assert sampling.boundary_prefix(hist, 3) == "0001"
    assert sampling.boundary_prefix(hist, 4) == "00a0"
    assert sampling.boundary_prefix(hist, 10) == "ffff"
    assert sampling.boundary_prefix(hist, 11) is None
