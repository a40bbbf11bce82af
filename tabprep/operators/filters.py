"""Filters, projections and the binary label. All are plain column
expressions, so Catalyst pushes the filters into the Parquet scan and prunes
unused columns."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.missing import present

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def keep_completed(df: DataFrame, cancelled: str = "cancelled",
                   diverted: str = "diverted") -> DataFrame:
    """Flights neither cancelled nor diverted (a null flag drops the row)."""
    return df.where((F.col(cancelled) == 0) & (F.col(diverted) == 0))


def clip_lower_col(c: Column, lo) -> Column:
    """Null-safe lower clip: values below ``lo`` become ``lo``, NULL stays NULL.
    (``greatest(NULL, lo)`` would turn unknown values into ``lo``.)"""
    return F.when(c < F.lit(lo), F.lit(lo)).otherwise(c)


def clip_lower(df: DataFrame, col: str, lo=0.0) -> DataFrame:
    """Replace ``col`` by its lower-clipped value."""
    return df.withColumn(col, clip_lower_col(F.col(col), lo).cast(df.schema[col].dataType))


# Columns known only after the flight (dropped as leakage).
LEAKAGE_COLUMNS = [
    "dep_delay", "taxi_out", "wheels_off", "wheels_on", "taxi_in", "arr_time",
    "dep_time", "actual_elapsed_time", "air_time", "delay_due_carrier",
    "delay_due_weather", "delay_due_nas", "delay_due_security",
    "delay_due_late_aircraft", "cancelled", "cancellation_code", "diverted",
]


def drop_leakage(df: DataFrame, cols: Sequence[str] = LEAKAGE_COLUMNS,
                 strict: bool = False) -> DataFrame:
    """Drop the leakage columns that exist. ``strict`` raises on absent
    names instead of ignoring them."""
    present = set(df.columns)
    absent = [c for c in cols if c not in present]
    if strict and absent:
        from tabprep.errors import MissingColumnsError
        raise MissingColumnsError(absent)
    return df.drop(*[c for c in cols if c in present])


def feature_columns(df: DataFrame, key: str = "row_id", label: str | None = None) -> list[str]:
    """P5: every column except the key and the label."""
    return [c for c in df.columns if c not in (key, label)]


def preview(df: DataFrame, cols: Sequence[str], n: int = 5, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows by key (a DataFrame has no first rows)."""
    return df.select(key, *[c for c in cols if c != key]).orderBy(key).limit(n)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("row_id",)) -> list[str]:
    """Numeric columns by type, minus the excluded ones (key, label)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in skip]


def existing(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The requested columns that exist, in the requested order."""
    present = set(df.columns)
    return [c for c in cols if c in present]


def positive_class(label: str) -> Column:
    """Late flights (``label > 0``); NULL and NaN in neither class."""
    return present(label) > 0


def zero_class(label: str) -> Column:
    """On-time flights (``label = 0``)."""
    return F.col(label) == 0


def binary_label_col(c: Column, threshold=15) -> Column:
    """P10: 1 when strictly above the threshold, else 0 (NULL and NaN -> 0)."""
    return F.when(present(c) > F.lit(threshold), 1).otherwise(0).cast("int")


def binary_label(df: DataFrame, col: str, threshold=15, out: str = "label_binary") -> DataFrame:
    return df.withColumn(out, binary_label_col(F.col(col), threshold))
