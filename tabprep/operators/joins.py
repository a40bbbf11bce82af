"""The joins that keep rows, attach labels, drop rows, look values up
and stack frames. With the label stored in the same row most of them are
plain filters; the general forms are key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lookups are broadcast only below this many rows and estimated bytes; above, the join shuffles.
BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTE_LIMIT = 128 * 1024 * 1024
#: Estimated bytes of a value: numbers and dates 8, text 40, anything else 400.
TEXT_BYTES, OTHER_BYTES = 40, 400


def row_bytes(schema: T.StructType) -> int:
    """Estimated bytes of a row in a broadcast table."""
    def width(t: T.DataType) -> int:
        if isinstance(t, T.StringType):
            return TEXT_BYTES
        return OTHER_BYTES if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else 8
    return 16 + sum(width(f.dataType) for f in schema.fields)


def keep_rows(df: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is in ``keys`` (left semi join)."""
    return df.join(keys.select(key), key, "left_semi")


def attach(df: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Add the label columns of the same key (inner join on the key)."""
    return df.join(labels, key)


def drop_rows(df: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is not in ``keys`` (left anti join)."""
    return df.join(keys.select(key), key, "left_anti")


def sized_broadcast(small: DataFrame, n_rows: int | None = None,
                    limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only when the counted rows, and the bytes estimated from
    them, are small."""
    if n_rows is None:
        n_rows = small.count()
    fits = n_rows <= limit and n_rows * row_bytes(small.schema) <= BROADCAST_BYTE_LIMIT
    return F.broadcast(small) if fits else small


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default=None,
           out: str | None = None, n_mapping_rows: int | None = None) -> DataFrame:
    """``out = mapping[key]`` with a default for keys not in the mapping
    (left join; the mapping is broadcast when its size is checked small)."""
    out = out or value
    m = mapping.select(F.col(key).alias("_lk"), F.col(value).alias("_lv"))
    joined = df.join(sized_broadcast(m, n_mapping_rows), F.col(key) == F.col("_lk"), "left")
    val = F.col("_lv") if default is None else F.coalesce(F.col("_lv"), F.lit(default))
    return joined.withColumn(out, val).drop("_lk", "_lv")


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack frames by column name (no dedup)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
