"""Label encoding and scaling, each as fit -> state, apply(state).

- Label codes rank the *distinct* values of every categorical column of
  train and test together (one grouped aggregate over stacked
  ``(column, value)`` pairs, then an ordered prefix sum over range-partitioned
  distinct values), in the column's own order: numbers numerically, text as text. The
  code table is written once to the checkpoint folder. Apply is a map literal
  inside the projection for columns with few codes, a broadcast left join for
  a checked-small table, and a shuffle join beyond that.
- Standard scaling uses the *population* deviation (zero -> divide by 1);
  min-max scaling maps a zero range to a divisor of 1. Both fit one aggregate
  on the training split and apply literals.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.missing import present
from tabprep.operators.cleaning import stacked_values
from tabprep.operators.joins import sized_broadcast
from tabprep.operators.ranges import ordered_prefix_sum
from tabprep.splits import Splits

# Columns with at most this many codes are encoded by a map literal. Spark looks
# a key up in a map by scanning it, so larger tables go through a broadcast
# hash join instead (measured: a 625-entry literal cost ~40x a 25-entry one).
MAP_LITERAL_LIMIT = 64


class LabelCodes(NamedTuple):
    codes: DataFrame            # column, value, code
    sizes: dict                 # column -> number of codes


def fit_label_encoder(splits: Splits, cols: Sequence[str], keep: bool = True) -> LabelCodes:
    """E1 fit: sorted distinct values of train ∪ test -> 0..k-1 per column."""
    both = splits.train.select(*cols).unionByName(splits.test.select(*cols))
    distinct = (stacked_values(both, cols).where(F.col("v_str").isNotNull())
                .groupBy("column", "v_num", "v_str").agg(F.lit(1).alias("_one")))
    ranked = ordered_prefix_sum(distinct, ["column"], [F.col("v_num").asc_nulls_last(), F.col("v_str").asc()],
                                F.lit(1), "code")
    codes = ranked.select("column", F.col("v_str").alias("value"), F.col("code").cast("int"))
    if keep:
        from tabprep.session import materialize
        codes = materialize(codes, "label-codes")
    sizes = {r["column"]: r["k"] for r in
             codes.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    return LabelCodes(codes, sizes)


def _sql_text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code_map(pairs) -> "F.Column":
    """A ``map<string,int>`` literal, parsed once by the JVM (building it from
    per-element Python literals costs one py4j call per value)."""
    keys = ", ".join(_sql_text(v) for v, _ in pairs)
    vals = ", ".join(str(int(k)) for _, k in pairs)
    return F.expr(f"map_from_arrays(array({keys}), array({vals}))")


def apply_label_encoder(df: DataFrame, state: LabelCodes, cols: Sequence[str]) -> DataFrame:
    """E1 apply: replace each categorical column by its code (NULL -> NULL;
    a value without a code raises, like an unseen label)."""
    small = [c for c in cols if state.sizes.get(c, 0) <= MAP_LITERAL_LIMIT]
    literal = {}
    if small:
        for row in state.codes.where(F.col("column").isin(small)).collect():
            literal.setdefault(row["column"], []).append((row["value"], row["code"]))
    out = df
    code_cols = {}
    for c in cols:
        if c in small:
            pairs = literal.get(c, [])
            code_cols[c] = (F.try_element_at(_code_map(pairs), F.col(c).cast("string"))
                            if pairs else F.lit(None).cast("int"))
        else:
            table = state.codes.where(F.col("column") == c).select(
                F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
            table = sized_broadcast(table, state.sizes.get(c, 0))
            out = out.join(table, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
            code_cols[c] = F.col(f"_c_{c}")

    def checked(c: str):
        # the code is named once: every mention in an expression is a look-up of its own
        unseen = F.when(F.col(c).isNotNull(), F.raise_error(F.lit(f"unseen label in column {c}")))
        return F.coalesce(code_cols[c], unseen).cast("int").alias(c)

    return out.select(*[checked(c) if c in code_cols else F.col(c) for c in df.columns])


def decode_labels(df: DataFrame, state: LabelCodes, cols: Sequence[str]) -> DataFrame:
    """Inverse of :func:`apply_label_encoder` (values come back as text)."""
    out = df
    for c in cols:
        table = state.codes.where(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        table = sized_broadcast(table, state.sizes.get(c, 0))
        out = (out.join(table, F.col(c) == F.col(f"_c_{c}"), "left")
               .withColumn(c, F.col(f"_v_{c}")).drop(f"_v_{c}", f"_c_{c}"))
    return out.select(*df.columns)


def _x(c: str, types: dict | None = None):
    """The column as a double, NaN as NULL. Integral columns (by ``types``) hold no NaN
    and are named once, since a mention may stand for a look-up of a code."""
    known = (types or {}).get(c)
    return present(F.col(c).cast("double"), known if isinstance(known, T.IntegralType) else None)


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def fit_standard(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E2 fit: one row ``column, mean, scale`` per column; scale is the
    population deviation, 1 when it is 0."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_x(c)).alias(f"m{i}"), F.stddev_pop(_x(c)).alias(f"s{i}")]
    row = train.agg(*aggs)
    pairs = ", ".join(f"'{c}', m{i}, s{i}" for i, c in enumerate(cols))
    return row.select(F.expr(f"stack({len(cols)}, {pairs}) as (column, mean, std)")).select(
        "column", "mean",
        F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0))
         .otherwise(F.col("std")).alias("scale"))


def fit_minmax(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E3 fit: ``column, mean (= min), scale (= max - min, 1 when 0)``."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(_x(c)).alias(f"lo{i}"), F.max(_x(c)).alias(f"hi{i}")]
    row = train.agg(*aggs)
    pairs = ", ".join(f"'{c}', lo{i}, hi{i}" for i, c in enumerate(cols))
    return row.select(F.expr(f"stack({len(cols)}, {pairs}) as (column, lo, hi)")).select(
        "column", F.col("lo").alias("mean"),
        F.when((F.col("hi") - F.col("lo") == 0) | F.col("hi").isNull(), F.lit(1.0))
         .otherwise(F.col("hi") - F.col("lo")).alias("scale"))


def apply_affine(df: DataFrame, params: DataFrame | list) -> DataFrame:
    """E2/E3 apply: ``(x - mean) / scale`` per fitted column, as literals
    (the parameter table has one row per column)."""
    rows = params.collect() if isinstance(params, DataFrame) else params
    repl, types = {}, _types(df)
    for r in rows:
        c = r["column"]
        if r["mean"] is None:
            repl[c] = _x(c, types)
        else:
            repl[c] = (_x(c, types) - F.lit(float(r["mean"]))) / F.lit(float(r["scale"]))
    return df.withColumns(repl) if repl else df


class Preprocessor(NamedTuple):
    codes: LabelCodes
    standard: DataFrame
    minmax: DataFrame


def preprocess(splits: Splits, numerical: Sequence[str], categorical: Sequence[str]):
    """Encode the categoricals (codes from train ∪ test), then scale the
    numerics (standard) and the codes (min-max), both fitted on train.
    Returns ``(Splits, Preprocessor)``; nothing is mutated."""
    codes = fit_label_encoder(splits, categorical) if categorical else None
    enc = splits if codes is None else splits.map(
        lambda d: apply_label_encoder(d, codes, categorical))
    # both parameter tables from one aggregate over the encoded training split
    aggs, types = [], _types(enc.train)
    for i, c in enumerate(numerical):
        aggs += [F.avg(_x(c, types)).alias(f"m{i}"), F.stddev_pop(_x(c, types)).alias(f"s{i}")]
    for i, c in enumerate(categorical):
        aggs += [F.min(_x(c, types)).alias(f"lo{i}"), F.max(_x(c, types)).alias(f"hi{i}")]
    row = enc.train.agg(*aggs).first() if aggs else None
    std_rows, mm_rows = [], []
    for i, c in enumerate(numerical):
        sd = row[f"s{i}"]
        std_rows.append({"column": c, "mean": row[f"m{i}"],
                         "scale": 1.0 if not sd else float(sd)})
    for i, c in enumerate(categorical):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        span = (hi - lo) if lo is not None and hi is not None else 0.0
        mm_rows.append({"column": c, "mean": lo, "scale": float(span) if span else 1.0})
    spark = splits.train.sparkSession
    schema = "column string, mean double, scale double"
    std = spark.createDataFrame([(r["column"], r["mean"], r["scale"]) for r in std_rows], schema)
    mm = spark.createDataFrame([(r["column"], r["mean"], r["scale"]) for r in mm_rows], schema)
    out = enc.map(lambda d: apply_affine(apply_affine(d, std_rows), mm_rows))
    return out, Preprocessor(codes, std, mm)


def apply_preprocessor(df: DataFrame, prep: Preprocessor, categorical: Sequence[str]) -> DataFrame:
    """New rows through fitted codes and scalers (E1 to E3), as :func:`preprocess` does with the splits."""
    coded = df if prep.codes is None else apply_label_encoder(df, prep.codes, categorical)
    return apply_affine(apply_affine(coded, prep.standard), prep.minmax)
