"""Shared column helpers of the text operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.joins import row_bytes

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What separates words of (lower-case) letters and digits, where everything
#: outside ASCII counts as a letter.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words between ASCII white space.
SPACE_GAP = r"[\x20\x09-\x0D]+"

#: Rows up to which a lookup side is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Bytes, estimated from the schema, up to which it is.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of an Arrow batch where a row holds a text or a set of shingles.
BATCH_ROWS = 1000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters; it is
    used where the text is pure ASCII, since it is faster)."""
    t = col(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, UPPER, UPPER.lower()))


def words(text, gap: str) -> Column:
    """The words between matches of ``gap``, in order; none for a null text.
    (Splitting is several times faster than extracting all matches.)"""
    return F.coalesce(F.array_remove(F.split(col(text), gap), ""), F.array().cast("array<string>"))


def text_key(text, row_id) -> Column:
    """A key shared by equal texts only (128 bits). Null texts never match
    anything, so they get a key of their own row instead of one hot null key."""
    return F.coalesce(F.md5(col(text)),
                      F.concat(F.lit("~"), F.coalesce(col(row_id).cast("string"), F.lit(""))))


def small_or_shuffled(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only when the counted ``rows`` stay below ``limit`` and the
    bytes estimated from them and the schema below ``max_bytes``; else both sides are shuffled."""
    return F.broadcast(df) if rows <= limit and rows * row_bytes(df.schema) <= max_bytes else merged(df)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that shuffles both. Without it Spark broadcasts a side of unknown
    length by its file's size, which is a small part of its rows' where values repeat, and
    does not know what an explode makes of it."""
    return df.hint("merge")


def released(run):
    """An Arrow pass that gives back what it freed. Workers live on through later
    stages, and the allocators keep freed memory for them."""
    def passed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
    return passed


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` with all its columns in one, ``row``, beside ``keys``: whatever names
    the columns have, none clashes with a key or with the other side of a join."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without_texts(docs: DataFrame, keys: DataFrame, text: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (all columns) without the texts whose MD5 is in ``keys.tkey``
    (a written table of distinct keys; a null text counts as empty). The keys are
    broadcast below a counted size, so that the texts are not shuffled."""
    side = small_or_shuffled(keys.select(F.col("tkey").alias("key")), keys.count(), limit)
    rows = whole_rows(docs, key=F.md5(F.coalesce(quoted(text), F.lit(""))))
    return rows.join(side, "key", "left_anti").select("row.*")
