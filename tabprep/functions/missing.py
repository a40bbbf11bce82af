"""Missing values as one notion: NULL and NaN are the same thing everywhere.

Spark orders NaN above every number (``NaN > 0`` is true) and counts it as a
value, so operators read their columns through :func:`present` at entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(c, dtype: T.DataType | None = None) -> Column:
    """The column with NaN as NULL; only floating types can hold NaN, so other
    types (when known) come back as they are."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype is not None and not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as NULL."""
    return df.select(*[present(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
