"""Duplicates, missing values and outliers.

- Duplicates are removed by a grouped aggregate over the feature columns that
  keeps the lowest key and the other columns of its row: the map-side partial
  aggregate collapses a hot duplicate group before the shuffle, where a window
  would send the whole group to one task. With fixed-width columns it is a hash
  aggregate (``min`` and ``min_by``), else a sort aggregate (``min`` of a struct).
- NULL and NaN are the same missing value in every operator.
- Fill values and outlier statistics are one aggregate each, over all columns
  at once; their few scalars come back as literals.
- Most-frequent values stack ``(column, value)`` pairs and count them in one
  grouped aggregate (also partial on the map side).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.errors import UnknownStrategyError
from tabprep.functions.missing import present
from tabprep.operators.filters import NUMERIC_TYPES, numeric_columns
from tabprep.splits import Splits

FIXED_WIDTH = (*NUMERIC_TYPES, T.BooleanType, T.DateType, T.TimestampType)
STRATEGIES = ("mean", "median", "most_frequent", "constant", "drop")


def drop_duplicate_rows(df: DataFrame, feature_cols: Sequence[str] | None = None,
                        key: str = "row_id", label: str | None = None) -> DataFrame:
    """Keep the lowest-key row of every group of equal feature values
    (NULLs compare equal); the key and the label are not compared."""
    feats = list(feature_cols) if feature_cols is not None else [
        c for c in df.columns if c not in (key, label)]
    rest = [c for c in df.columns if c not in feats and c != key]
    types = {f.name: f.dataType for f in df.schema.fields}
    if all(isinstance(types[c], FIXED_WIDTH) for c in [key, *rest]):
        # one hash aggregate: the key orders the rows of a group, so the other
        # columns may come from separate aggregates unless rows share a key
        return (df.groupBy(*feats).agg(F.min(key).alias(key), *[F.min_by(c, key).alias(c) for c in rest])
                .select(*df.columns))
    first = F.min(F.struct(F.col(key), *[F.col(c) for c in rest])).alias("_first")
    grouped = df.groupBy(*feats).agg(first)
    return grouped.select(*[F.col(c) for c in feats],
                          *[F.col(f"_first.{c}").alias(c) for c in [key, *rest]]
                          ).select(*df.columns)


def null_counts(df: DataFrame) -> DataFrame:
    """``column, n_null`` for every column (NaN counts), from one aggregate."""
    cols = df.columns
    row = df.agg(*[F.count(F.when(present(F.col(f"`{f.name}`"), f.dataType).isNull(), 1)).alias(f"n{i}")
                   for i, f in enumerate(df.schema.fields)])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return row.select(F.expr(f"stack({len(cols)}, {pairs}) as (column, n_null)")).select(
        "column", F.col("n_null").cast("bigint"))


def stacked_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, v_num, v_str`` rows, one per (row, column), from a single
    projection (``inline`` of an array of structs, one scan): numeric columns
    order by ``v_num``, the others by ``v_str``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in cols:
        numeric = isinstance(types[c], NUMERIC_TYPES)
        v = present(c, types[c])
        structs.append(F.struct(
            F.lit(c).alias("column"),
            (v.cast("double") if numeric else F.lit(None).cast("double")).alias("v_num"),
            v.cast("string").alias("v_str")))
    return df.select(F.inline(F.array(*structs)))


def most_frequent_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, v_num, v_str, n``: the most frequent non-null value of every
    column; ties go to the smallest value (in the column's own order)."""
    counts = (stacked_values(df, cols).where(F.col("v_str").isNotNull())
              .groupBy("column", "v_num", "v_str").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), "v_num", "v_str")).alias("b"))
    return best.select("column", "b.v_num", "b.v_str", (-F.col("b.neg_n")).alias("n"))


def fit_fill_values(df: DataFrame, strategy: str, cols: Sequence[str] | None = None,
                    value=None, key: str = "row_id", label: str | None = None) -> dict:
    """Fill value per column for ``mean``, ``median``, ``most_frequent`` or
    ``constant``. Mean and median cover numeric columns only."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if strategy in ("mean", "median"):
        cols = list(cols) if cols is not None else numeric_columns(df, exclude=(key, label))
        cols = [c for c in cols if isinstance(types[c], NUMERIC_TYPES)]
        if not cols:
            return {}
        if strategy == "mean":
            row = df.agg(*[F.avg(present(c, types[c])).alias(c) for c in cols]).first()
            return {c: row[c] for c in cols if row[c] is not None}
        from tabprep.operators.describe import exact_quantiles
        q = exact_quantiles(df, cols, [0.5])
        return {c: q[c][0] for c in cols if q[c][0] is not None}
    if strategy == "most_frequent":
        cols = list(cols) if cols is not None else [c for c in df.columns if c not in (key, label)]
        out = {}
        for r in most_frequent_values(df, cols).collect():
            c = r["column"]
            # the text is exact in the column's own type; the double orders only
            out[c] = r["v_str"]
        return out
    if strategy == "constant":
        if value is None:
            raise ValueError("constant strategy needs a value")
        cols = list(cols) if cols is not None else [c for c in df.columns if c not in (key, label)]
        ok = []
        for c in cols:
            t = types[c]
            if isinstance(value, str) and isinstance(t, T.StringType):
                ok.append(c)
            elif isinstance(value, (int, float)) and not isinstance(value, bool) and \
                    isinstance(t, NUMERIC_TYPES):
                if isinstance(t, T.IntegralType) and value != int(value):
                    raise ValueError(f"constant {value!r} does not fit the integral column {c}")
                ok.append(c)
        return {c: value for c in ok}
    raise UnknownStrategyError(f"invalid strategy: {strategy!r}; use one of {STRATEGIES}")


def apply_fill_values(df: DataFrame, fills: dict, widen: bool = False) -> DataFrame:
    """Replace NULLs by the fitted values. ``widen`` turns filled integral
    columns into doubles (a mean or median need not be integral)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    repl = {}
    for c, v in fills.items():
        t = types[c]
        target = T.DoubleType() if widen and isinstance(t, NUMERIC_TYPES) else t
        repl[c] = F.coalesce(present(c, t).cast(target), F.lit(v).cast(target))
    return df.withColumns(repl) if repl else df


def fill_missing(splits: Splits, strategy: str = "drop", value=None, fit_on: str = "each",
                 cols: Sequence[str] | None = None, key: str = "row_id",
                 label: str | None = "arr_delay") -> Splits:
    """Handle missing values in both splits.

    ``drop`` (C7) drops rows with a NULL in any feature column. The fill
    strategies (C3-C6) fit on each split separately (``fit_on="each"``, as the
    studied pipeline did) or on the training split only (``fit_on="train"``).
    """
    if strategy not in STRATEGIES:
        raise UnknownStrategyError(f"invalid strategy: {strategy!r}; use one of {STRATEGIES}")
    if strategy == "drop":
        def dropper(d: DataFrame) -> DataFrame:
            subset = list(cols) if cols is not None else [c for c in d.columns if c != label]
            return d.na.drop(how="any", subset=subset)
        return splits.map(dropper)
    widen = strategy in ("mean", "median")
    if fit_on == "train":
        fills = fit_fill_values(splits.train, strategy, cols, value, key, label)
        return splits.map(lambda d: apply_fill_values(d, fills, widen))
    if fit_on != "each":
        raise ValueError("fit_on must be 'each' or 'train'")
    return Splits(*[apply_fill_values(d, fit_fill_values(d, strategy, cols, value, key, label), widen)
                    for _, d in splits.items()])


def outlier_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and sample standard deviation of every column's present values, one
    aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        x = present(F.col(c).cast("double"))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def outlier_flag(stats: dict, threshold: float) -> Column:
    """True when any column's |z| exceeds the threshold. A missing value
    (NULL or NaN), or a constant column (zero deviation), never flags."""
    flag = F.lit(False)
    for c, (mean, std) in stats.items():
        if mean is None or std is None:
            continue
        z = F.try_divide(present(F.col(c).cast("double")) - F.lit(mean), F.lit(std))
        flag = flag | F.coalesce(F.abs(z) > F.lit(threshold), F.lit(False))
    return flag


def outlier_flags(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 2.0,
                  key: str = "row_id", label: str | None = None,
                  out: str = "is_outlier") -> DataFrame:
    """Add a boolean outlier column (z-score, sample deviation)."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=(key, label))
    return df.withColumn(out, outlier_flag(outlier_stats(df, cols), threshold))


def remove_outliers(splits: Splits, threshold: float = 2.0, cols: Sequence[str] | None = None,
                    key: str = "row_id", label: str | None = "arr_delay") -> Splits:
    """Drop flagged rows from the training split only (one pass of
    statistics, not iterated)."""
    train = splits.train
    cols = list(cols) if cols is not None else numeric_columns(train, exclude=(key, label))
    flag = outlier_flag(outlier_stats(train, cols), threshold)
    return Splits(train.where(~flag), splits.test)
