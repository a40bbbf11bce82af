"""Plan shapes that the scale design relies on (checked on the physical plan,
so a regression shows up as a test failure, not only as a slow job)."""

import re

from pyspark.sql import functions as F

from tabprep.operators import describe, projection, sampling

from .conftest import SF001, SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sample_n_is_one_filter_in_the_scan_stage(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    p = plan(sampling.sample_n(orders, 5000, "o_orderkey"))
    assert "FileScan parquet" in p
    for op in ("Exchange", "Sort", "TakeOrderedAndProject", "Window"):
        assert op not in p, op


def test_correlation_reduces_rows_inside_the_scan_tasks(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    cols = ["o_totalprice", "o_custkey", "o_orderkey"]
    p = plan(describe.correlation_matrix(orders, cols))
    # tasks give p x p sums, merged by one partial aggregate of four functions; no row is exploded
    assert "MapInPandas" in p and "Generate" not in p
    partial = [line for line in p.splitlines() if "partial_sum(n" in line]
    assert partial and all(len(re.findall(r"partial_\w+\(", line)) == 4 for line in partial)
    # the scan reads only the named columns
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == sorted(cols)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_label_codes_are_ranked_by_range(spark, run001):
    from tabprep.operators import ranges
    t = spark.createDataFrame([("a", i) for i in range(500)], "column string, v int")
    p = plan(ranges.ordered_prefix_sum(t, ["column"], ["v"], F.lit(1)))
    windows = [line for line in p.splitlines() if "Window [" in line and "_range" not in line.split("windowspec")[0]]
    assert not [line for line in windows if "[column#" in line and "_range" not in line]
    got = {r["v"]: r["before"] for r in ranges.ordered_prefix_sum(t, ["column"], ["v"], F.lit(1)).collect()}
    assert got == {i: i for i in range(500)}


def test_duplicates_are_a_hash_aggregate_and_shuffled_once(spark, flights001):
    from tabprep.operators import cleaning
    feats = ["fl_date", "airline_code", "origin", "dest", "crs_dep_time", "crs_arr_time", "crs_elapsed_time",
             "distance"]
    df = flights001.select("row_id", "arr_delay", *feats)
    assert "SortAggregate" not in plan(cleaning.drop_duplicate_rows(df, feats, "row_id", "arr_delay"))


def test_column_stats_plan_does_not_grow_with_columns(spark):
    df = spark.range(100).select(*[(F.col("id") * i).cast("double").alias(f"c{i}")
                                   for i in range(40)])
    stacked = describe.stacked(df, [f"c{i}" for i in range(40)])
    p = plan(stacked.groupBy("k").agg(F.count(F.lit(1)), F.avg("x"), F.stddev_samp("x"),
                                      F.min("x"), F.max("x")))
    partial = [line for line in p.splitlines() if "partial_avg" in line]
    assert len(partial) == 1 and len(re.findall(r"partial_\w+\(", partial[0])) == 5


def test_knn_graph_has_no_pairwise_product(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    p = plan(projection.knn_graph(emb, "embedding", 5, key="vec_id"))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_knn_cells_prune_in_few_dimensions(spark):
    report = {}
    points = spark.range(3000).select("id", F.rand(3).alias("x"), F.rand(4).alias("y"))
    projection.knn_graph(points, ["x", "y"], 5, key="id", report=report)
    assert report["rows"] == 3000 and report["pairs"] < 0.1 * 3000 ** 2
