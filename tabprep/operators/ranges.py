"""Ordered prefix sums without a global window.

Rows are range-partitioned by the wanted order (the number of partitions is the
session's, so it follows the cluster and the data), written with their partition
number, and summed in two steps: totals per partition give each partition's
offset (a table of groups x partitions), and a window inside each partition adds
the rest. No task sees more than one range, however few the groups are.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.session import materialize


def ordered_prefix_sum(tbl: DataFrame, parts: Sequence[str], order: Sequence[Column | str],
                       weight: Column | str, out: str = "before") -> DataFrame:
    """``tbl`` with the exclusive sum ``out`` of ``weight`` over the rows before
    it in ``order`` within ``parts`` (rows equal in all of ``order`` share no
    defined order; callers pass tables of distinct values)."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    ranged = materialize(tbl.repartitionByRange(*[F.col(p) for p in parts], *order)
                         .withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*parts, "_range").agg(F.sum(weight).alias("_total"))
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*parts, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(offsets), [*parts, "_range"])
            .withColumn(out, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("_range", "_offset"))
