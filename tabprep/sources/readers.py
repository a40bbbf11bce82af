"""Scanning a flights table and guarding it.

``read_flights`` reads CSV (every column as text first, missing-value tokens
normalised to NULL, then cast to the requested schema) or Parquet (NaN mapped to
NULL). The guards raise typed errors instead of printing and carrying on.

CSV follows RFC 4180: a quote inside a quoted field is doubled, a quoted field may
hold separators and line ends, a backslash is a character like any other. A record
with fewer fields than the header is filled up with NULL. One with more is
malformed: the scan fails with a typed error, or (``on_bad="side"``) leaves the
record out, and :func:`rejected_records` has its text.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.errors import (
    EmptyInputError,
    MalformedRecordsError,
    MissingColumnsError,
    MissingSourceError,
    SingleClassError,
)
from tabprep.functions.missing import nan_to_null

# The text tokens pandas' CSV reader treats as missing by default.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# The words pandas' CSV reader takes for booleans.
BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)\s*$"
#: The column that holds the text of records whose number of fields differs from the header's.
RECORD = "_record"

# The columns the load step requires.
REQUIRED_COLUMNS = ["cancelled", "diverted", "arr_delay"]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches something, asked of the file system that
    Spark itself would read it from (the default one for a path without scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return found is not None and len(found) > 0


def _csv(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, list[str]]:
    """The records as text columns and ``RECORD``, and the header's names."""
    reader = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line))
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    return reader.schema(schema).option("columnNameOfCorruptRecord", RECORD).csv(path), names


def _record(names: Sequence[str]) -> Column:
    """The text of a record, as an expression over a further column too (Spark reads no
    file for the text alone)."""
    return F.concat_ws("", F.col(RECORD), F.substring(F.col(f"`{names[0]}`"), 1, 0))


def _surplus(names: Sequence[str]) -> Column:
    """Whether a record has more fields than the header: its separators outside quotes
    (quoted parts, with doubled quotes as two parts side by side, are taken out first)."""
    bare = F.regexp_replace(_record(names), '"[^"]*"', "")
    return F.col(RECORD).isNotNull() & (
        F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(names))


def rejected_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The malformed records of CSV files: ``record`` (their text)."""
    raw, names = _csv(spark, path, multi_line)
    return raw.where(_surplus(names)).select(_record(names).alias("record"))


def read_flights(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str = "csv", lower_names: bool = True, on_bad: str = "raise",
                 multi_line: bool = True) -> DataFrame:
    """Scan a flights table.

    CSV is read with a header, all fields as text; the missing-value tokens
    become NULL, then each column is cast to ``schema`` (ANSI cast: bad text
    raises). Without a schema, text columns stay text unless every value is a number or
    a boolean, which is decided by one aggregate pass (the same inference as
    a whole-file scan) that counts malformed records too; with one, they fail the job that
    meets them. Records over several lines need whole files per task; ``multi_line=False``
    lets Spark split files that have none. Parquet keeps its own types. Column names are
    lowered.
    """
    if on_bad not in ("raise", "side"):
        raise ValueError(f"unknown way with malformed records: {on_bad}")
    if not _exists(spark, path):
        raise MissingSourceError(f"input not found: {path}")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        raw, names = _csv(spark, path, multi_line)
        bad = _surplus(names)
        norm = raw.select(*[
            F.when(F.col(f"`{c}`").isin(MISSING_TOKENS), F.lit(None).cast("string"))
             .otherwise(F.col(f"`{c}`")).alias(c) for c in names], bad.alias(RECORD))
        if schema is None:
            schema, malformed = _infer(norm, names)
            if malformed and on_bad == "raise":
                raise MalformedRecordsError(malformed, path)
        message = F.lit(f"a record of {path} has more fields than the header")
        norm = norm.where(~F.col(RECORD) if on_bad == "side" else
                          F.when(F.col(RECORD), F.raise_error(message).cast("boolean")).otherwise(True))
        by_name = {f.name.lower(): f.dataType for f in schema.fields}
        df = norm.select(*[
            (F.col(f"`{c}`").cast(by_name[c.lower()]) if c.lower() in by_name else F.col(f"`{c}`"))
            .alias(c) for c in names])
    else:
        raise ValueError(f"unsupported format: {fmt}")
    if lower_names:
        df = df.toDF(*[c.lower() for c in df.columns])
    return nan_to_null(df)


def _infer(df: DataFrame, names: Sequence[str]) -> tuple[T.StructType, int]:
    """One aggregate pass: a text column is integer, double or boolean if every
    non-null value is; and the number of malformed records, which decide nothing."""
    good = ~F.col(RECORD)
    aggs = [F.count(F.when(F.col(RECORD), 1)).alias("bad")]
    for i, c in enumerate(names):
        col = F.when(good, F.col(f"`{c}`"))
        aggs += [F.count(col).alias(f"n{i}"),
                 F.count(F.when(col.rlike(INTEGER), col.try_cast(T.LongType()))).alias(f"l{i}"),
                 F.count(F.when(col.rlike(NUMBER), 1)).alias(f"d{i}"),
                 F.count(F.when(col.isin(BOOLEANS), 1)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    fields = []
    for i, c in enumerate(names):
        kinds = (("l", T.LongType()), ("d", T.DoubleType()), ("b", T.BooleanType()))
        kind = next((t for k, t in kinds if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), T.StringType())
        fields.append(T.StructField(c, kind, True))
    return T.StructType(fields), row["bad"]


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail when required columns are absent (schema only, no job)."""
    present = set(df.columns)
    missing = [c for c in cols if c not in present]
    if missing:
        raise MissingColumnsError(missing)
    return df


def require_rows(df: DataFrame, message: str = "table is empty") -> DataFrame:
    """Fail when the table has no rows (a one-row probe, not a count)."""
    if df.isEmpty():
        raise EmptyInputError(message)
    return df


def require_classes(counts: dict, classes: Sequence) -> None:
    """S3: fail when one of the classes needed for balancing is empty."""
    empty = [c for c in classes if not counts.get(c)]
    if empty:
        raise SingleClassError(f"no rows in class(es) {empty}; cannot balance")
