"""The flights-shaped view over the driver's TPC-H-like tables.

One row per order plus planted duplicates, with planted nulls, 24:00 clock
values, leakage columns and a target that is negative, zero and positive. It
is built with DataFrame joins and aggregates over ``orders``, ``lineitem``,
``customer``, ``supplier`` and ``nation``, so its size grows with theirs.

The same view as DuckDB SQL is :func:`flights_sql_ctes`; the two must stay
equal (row for row) because every oracle query starts from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Planted-pattern moduli of the fixture (fixed values of the view definition).
DEST_NULL_MOD = 41
ELAPSED_NULL_MOD = 31
CANCELLED_MOD = 50
DIVERTED_MOD = 97
DUPLICATE_MOD = 53
DUPLICATE_OFFSET = 1_000_000_000
CLOCK_MOD = 1441
CLOCK_MULT = 7919

FLIGHT_COLUMNS = [
    "row_id", "fl_date", "airline_code", "origin", "dest", "crs_dep_time",
    "crs_arr_time", "crs_elapsed_time", "distance", "arr_delay", "cancelled",
    "diverted", "dep_delay", "cancellation_code",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hhmm(minutes: Column) -> Column:
    """minutes-of-day -> hhmm integer as written by the view (1441 -> 2400)."""
    return (minutes + F.lit(40) * F.floor(minutes / F.lit(60.0))).cast("int")


def flights_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flights_v`` as a Spark DataFrame (columns :data:`FLIGHT_COLUMNS`)."""
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("li_supp"),
             F.sum("l_quantity").alias("li_qty"),
             F.min("l_shipdate").alias("li_ship"))
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    origin = nation.select(F.col("n_nationkey").alias("c_nationkey"),
                           F.col("n_name").alias("origin"))
    dest = nation.select(F.col("n_nationkey").alias("s_nationkey"),
                         F.col("n_name").alias("dest_name"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("li_supp"), "s_nationkey")

    b = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(origin, "c_nationkey")
        .join(li, orders.o_orderkey == li.l_orderkey, "left")
        .join(supplier, "li_supp", "left")
        .join(dest, "s_nationkey", "left")
    )
    k = F.col("o_orderkey")
    m = (k * F.lit(CLOCK_MULT)) % F.lit(CLOCK_MOD)
    arr_minutes = (m + F.lit(30) + F.col("li_qty")) % F.lit(1440)
    delay = F.datediff(F.col("li_ship").cast("date"),
                       F.col("o_orderdate").cast("date")).cast("double")
    f0 = b.select(
        k.alias("row_id"),
        F.col("o_orderdate").cast("date").alias("fl_date"),
        F.col("o_orderpriority").alias("airline_code"),
        F.col("origin"),
        F.when(k % DEST_NULL_MOD == 0, F.lit(None).cast("string"))
         .otherwise(F.col("dest_name")).alias("dest"),
        _hhmm(m).alias("crs_dep_time"),
        _hhmm(arr_minutes).alias("crs_arr_time"),
        F.when(k % ELAPSED_NULL_MOD == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(30) + F.col("li_qty")).cast("double")).alias("crs_elapsed_time"),
        (F.col("o_totalprice") / F.lit(100.0)).alias("distance"),
        delay.alias("arr_delay"),
        F.when(k % CANCELLED_MOD == 0, 1).otherwise(0).cast("int").alias("cancelled"),
        F.when(k % DIVERTED_MOD == 0, 1).otherwise(0).cast("int").alias("diverted"),
        delay.alias("dep_delay"),
        F.when(k % CANCELLED_MOD == 0, F.lit("B")).alias("cancellation_code"),
    )
    # the planted duplicates come from the same joined row (one evaluation of
    # the joins, not a union that runs them twice)
    offsets = F.when(F.col("row_id") % DUPLICATE_MOD == 0,
                     F.array(F.lit(0), F.lit(DUPLICATE_OFFSET))).otherwise(F.array(F.lit(0)))
    return (f0.withColumn("_dup", F.explode(offsets))
            .withColumn("row_id", F.col("row_id") + F.col("_dup")).drop("_dup"))


def flights_sql_ctes() -> str:
    """DuckDB CTE list ending in ``flights_v`` (no leading ``WITH``)."""
    return f"""
li as (
  select l_orderkey, min(l_suppkey) as s, sum(l_quantity) as q, min(l_shipdate) as sd
  from lineitem group by l_orderkey),
b as (
  select o_orderkey as k, o_orderdate as od, o_orderpriority as pr, o_totalprice as tp,
         (o_orderkey * {CLOCK_MULT}) % {CLOCK_MOD} as m, n1.n_name as origin, n2.n_name as dest,
         li.q as q, cast(li.sd as date) - cast(o.o_orderdate as date) as delay
  from orders o
  join customer c on o.o_custkey = c.c_custkey
  join nation n1 on c.c_nationkey = n1.n_nationkey
  left join li on li.l_orderkey = o.o_orderkey
  left join supplier s on s.s_suppkey = li.s
  left join nation n2 on s.s_nationkey = n2.n_nationkey),
f0 as (
  select k as row_id, cast(od as date) as fl_date, pr as airline_code, origin,
    case when k % {DEST_NULL_MOD} = 0 then null else dest end as dest,
    cast(m + 40 * floor(m / 60e0) as int) as crs_dep_time,
    cast((m+30+q) % 1440 + 40 * floor(((m+30+q) % 1440) / 60e0) as int) as crs_arr_time,
    case when k % {ELAPSED_NULL_MOD} = 0 then null else cast(30 + q as double) end as crs_elapsed_time,
    tp / 100e0 as distance, cast(delay as double) as arr_delay,
    cast(case when k % {CANCELLED_MOD} = 0 then 1 else 0 end as int) as cancelled,
    cast(case when k % {DIVERTED_MOD} = 0 then 1 else 0 end as int) as diverted,
    cast(delay as double) as dep_delay,
    case when k % {CANCELLED_MOD} = 0 then 'B' end as cancellation_code
  from b),
flights_v as (
  select * from f0
  union all
  select row_id + {DUPLICATE_OFFSET}, fl_date, airline_code, origin, dest, crs_dep_time,
    crs_arr_time, crs_elapsed_time, distance, arr_delay, cancelled, diverted, dep_delay,
    cancellation_code
  from f0 where row_id % {DUPLICATE_MOD} = 0)"""
