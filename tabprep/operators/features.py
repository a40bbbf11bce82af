"""The feature stage (F1-F11 together) and E4, target-mean encoding.

``engineer_features`` is one projection. ``fit_target_mean`` learns the mean
target per key on the training split (a grouped aggregate, partial on the map
side); ``apply_target_mean`` is a broadcast left join - the map has one row per
distinct key, and its size is checked before broadcasting.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions import features as ff
from tabprep.operators.joins import sized_broadcast
from tabprep.session import materialize

# The engineered columns in the order the studied pipeline previews them.
NEW_FEATURES = [
    "fl_date", "month", "is_holiday_month", "day_of_week", "is_weekend", "season",
    "crs_dep_hour", "time_of_day", "flight_type", "route", "crs_arr_hour",
    "planned_speed", "avg_delay_per_hour",
]


def engineer_features(df: DataFrame, date: str = "fl_date", dep: str = "crs_dep_time",
                      arr: str = "crs_arr_time", origin: str = "origin", dest: str = "dest",
                      distance: str = "distance", elapsed: str = "crs_elapsed_time") -> DataFrame:
    """Calendar, clock, route, distance and speed features as one projection."""
    d = ff.flight_date(F.col(date))
    month = ff.month_of(d)
    dow = ff.day_of_week(d)
    dep_hour = ff.hour_of(F.col(dep))
    return df.withColumns({
        date: d,
        "month": month.cast("int"),
        "day_of_week": dow.cast("int"),
        "is_weekend": ff.is_weekend(dow).cast("int"),
        "season": ff.season(month).cast("int"),
        "is_holiday_month": ff.is_holiday_month(month).cast("int"),
        "crs_dep_hour": dep_hour,
        "time_of_day": ff.time_of_day(dep_hour),
        "route": ff.route(F.col(origin), F.col(dest)),
        "flight_type": ff.flight_type(F.col(distance)),
        "crs_arr_hour": ff.hour_of(F.col(arr)),
        "planned_speed": ff.planned_speed(F.col(distance), F.col(elapsed)),
    })


class TargetMean(NamedTuple):
    mapping: DataFrame      # key, mean
    default: float          # unweighted mean of the group means; 0 if none
    n_keys: int
    key: str
    value: str


def fit_target_mean(train: DataFrame, key: str = "crs_dep_hour", label: str = "arr_delay",
                    value: str = "avg_delay_per_hour") -> TargetMean:
    """E4 fit (A1 underneath): mean target per non-null key on the training
    split; the default for unseen keys is the mean of the group means."""
    # written once: every later use reads this small table, not the plan behind it
    mapping = materialize(train.where(F.col(key).isNotNull())
                          .groupBy(key).agg(F.avg(label).alias(value)), "target-means")
    row = mapping.agg(F.avg(value).alias("d"), F.count(F.lit(1)).alias("n")).first()
    default = float(row["d"]) if row["n"] else 0.0
    return TargetMean(mapping, default, int(row["n"]), key, value)


def apply_target_mean(df: DataFrame, state: TargetMean) -> DataFrame:
    """E4 apply: broadcast left join on the key, default for misses."""
    m = state.mapping.select(F.col(state.key).alias("_tk"), F.col(state.value).alias("_tv"))
    joined = df.join(sized_broadcast(m, state.n_keys), F.col(state.key) == F.col("_tk"), "left")
    return (joined.withColumn(state.value, F.coalesce(F.col("_tv"), F.lit(state.default)))
            .drop("_tk", "_tv"))
