"""M1-M4 and the shared hash order.

Every random choice is an order by ``md5('<tag>:<seed>:' || key)`` (ties by
key), the same text in Spark and DuckDB, so samples are exact in size and
reproducible on both engines.

Prefixes (the n first rows in hash order) never sort the table:

1. count rows per hash prefix of 4 hex digits (at most 65,536 groups, partial
   aggregation, a tiny shuffle);
2. running sums over those counts locate the boundary prefix; every row whose
   prefix is lower is kept, every higher one dropped;
3. only the boundary prefix is refined, 4 more hex digits per level, until
   it holds few rows; those are taken in order and the n-th row's
   ``(hash, key)`` becomes a literal bound.

The result is one filter ``(h, key) <= (h_n, key_n)`` evaluated in the scan's
codegen stage: no window, no shuffle of the data, no row on the driver beyond
the bounded boundary group. Full ranks (``hash_rank``) add a row number inside
each prefix group plus the group's offset, a shuffle by a uniform hash prefix.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.operators.filters import positive_class

DEFAULT_SEED = 42
PREFIX_DIGITS = 4
BOUNDARY_ROWS = 50_000


def hash_col(key: str, seed: int = DEFAULT_SEED, tag: str = "sample") -> Column:
    """``md5('<tag>:<seed>:' || cast(key as string))`` - lowercase hex text."""
    return F.md5(F.concat(F.lit(f"{tag}:{seed}:"), F.col(key).cast("string")))


def _le_bound(h: Column, key: Column, h_n: str, key_n) -> Column:
    return (h < F.lit(h_n)) | ((h == F.lit(h_n)) & (key <= F.lit(key_n)))


def prefix_bound(df: DataFrame, n: int, key: str, seed: int = DEFAULT_SEED,
                 tag: str = "sample", boundary_rows: int = BOUNDARY_ROWS,
                 first_level: dict | None = None):
    """The ``(hash, key)`` of the n-th row in hash order, or ``None`` when the
    table has at most n rows. Jobs: one grouped count per refinement level
    (usually one or two; the first can be passed in as ``first_level``,
    prefix -> count, when an earlier aggregate already produced it), then one
    bounded fetch of the boundary group."""
    if n <= 0:
        return ("", None)
    h = hash_col(key, seed, tag)
    probe = df.select(h.alias("_h"), F.col(key).alias("_k"))
    digits, prefix, before = PREFIX_DIGITS, "", 0
    while True:
        if not prefix and first_level is not None:
            rows = [{"p": k, "count": v} for k, v in first_level.items()]
        else:
            scoped = probe if not prefix else probe.where(
                F.substring("_h", 1, len(prefix)) == F.lit(prefix))
            rows = (scoped.groupBy(F.substring("_h", 1, digits).alias("p"))
                    .count().collect())
        rows.sort(key=lambda r: r["p"])
        total = before + sum(r["count"] for r in rows)
        if total <= n and not prefix:
            return None
        run = before
        chosen = None
        for r in rows:
            if run + r["count"] >= n:
                chosen = r
                break
            run += r["count"]
        if chosen is None:  # cannot happen when total > n
            return None
        prefix, before = chosen["p"], run
        if chosen["count"] <= boundary_rows or digits >= 32:
            group = probe.where(F.substring("_h", 1, len(prefix)) == F.lit(prefix))
            if digits < 32:  # rows of one whole hash are rows of one key
                group = group.orderBy("_h", "_k").limit(n - before)
            last = group.agg(F.max(F.struct("_h", "_k")).alias("last")).first()["last"]
            return (last["_h"], last["_k"])
        digits = min(32, digits + PREFIX_DIGITS)


def boundary_prefix(first_level: dict, n: int) -> str | None:
    """The first-level hash prefix holding the n-th row in hash order, from
    its prefix -> count histogram; ``None`` when the n first rows are the
    whole table. Every row whose prefix is greater is never among the n first,
    so ``prefix <= boundary`` is a superset filter known before any fetch."""
    if n <= 0:
        return ""
    run = 0
    for p in sorted(first_level):
        run += first_level[p]
        if run >= n:
            return p
    return None


def prefix_condition(df: DataFrame, n: int, key: str, seed: int = DEFAULT_SEED,
                     tag: str = "sample", first_level: dict | None = None) -> Column:
    """Boolean column: the row is among the n first in hash order."""
    bound = prefix_bound(df, n, key, seed, tag, first_level=first_level)
    if bound is None:
        return F.lit(True)
    if bound[1] is None:
        return F.lit(False)
    return _le_bound(hash_col(key, seed, tag), F.col(key), bound[0], bound[1])


def sample_n(df: DataFrame, n: int, key: str = "row_id", seed: int = DEFAULT_SEED,
             tag: str = "sample") -> DataFrame:
    """M2: exactly ``min(n, rows)`` rows, without replacement, in hash order."""
    return df.where(prefix_condition(df, n, key, seed, tag))


def rank_by(df: DataFrame, h: Column, key: str, partition_by: Sequence[str] = (),
            out: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row by ``(h, key)`` within groups, where
    ``h`` is a uniform hex hash: group offsets come from counts per 4-digit
    hash prefix (a bounded table, broadcast), plus a row number inside each
    prefix group (a shuffle on a uniform hash prefix, so no hot partition and
    no global sort)."""
    parts = list(partition_by)
    with_h = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    counts = with_h.groupBy(*parts, "_p").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(F.sum("_c").over(
            Window.partitionBy(*parts).orderBy("_p")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    w = Window.partitionBy(*parts, "_p").orderBy("_h", key)
    # without groups the offset table has at most 65,536 rows: broadcast it;
    # with groups it grows with their number, so the planner decides
    offsets = F.broadcast(offsets) if not parts else offsets
    return (with_h.join(offsets, [*parts, "_p"])
            .withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
            .drop("_h", "_p", "_off"))


def hash_rank(df: DataFrame, key: str = "row_id", seed: int = DEFAULT_SEED,
              tag: str = "shuffle", out: str = "rank",
              partition_by: Sequence[str] = ()) -> DataFrame:
    """Exact 1-based rank of every row in ``tag`` hash order (optionally
    within groups); see :func:`rank_by`."""
    return rank_by(df, hash_col(key, seed, tag), key, partition_by, out)


def shuffle_order(df: DataFrame, key: str = "row_id", seed: int = DEFAULT_SEED,
                  out: str = "shuffle_rank") -> DataFrame:
    """M3: the full shuffle as an order column (a DataFrame has no order)."""
    return hash_rank(df, key, seed, "shuffle", out)


def class_prefix_counts(df: DataFrame, label: str, key: str = "row_id",
                        seed: int = DEFAULT_SEED, tag: str = "balance",
                        positive=None, negative=None,
                        scope: Column | None = None) -> tuple[dict, dict]:
    """One grouped count over ``(class, 4-digit hash prefix)`` (at most
    4 x 65,536 groups): the sizes ``raw`` (every row), ``all`` (rows in
    ``scope``), ``pos`` and ``neg`` (in scope), and per class the first-level
    prefix histogram that balancing needs."""
    pos = positive if positive is not None else positive_class(label)
    neg = negative if negative is not None else F.col(label) == 0
    cls = F.when(pos, F.lit("pos")).when(neg, F.lit("neg")).otherwise(F.lit("other"))
    if scope is not None:
        cls = F.when(~F.coalesce(scope, F.lit(False)), F.lit("out")).otherwise(cls)
    p = F.substring(hash_col(key, seed, tag), 1, PREFIX_DIGITS)
    rows = df.groupBy(cls.alias("c"), p.alias("p")).count().collect()
    counts = {"raw": 0, "all": 0, "pos": 0, "neg": 0}
    hist: dict = {"pos": {}, "neg": {}, "other": {}, "out": {}}
    for r in rows:
        counts["raw"] += r["count"]
        if r["c"] != "out":
            counts["all"] += r["count"]
        if r["c"] in ("pos", "neg"):
            counts[r["c"]] += r["count"]
        hist[r["c"]][r["p"]] = r["count"]
    return counts, hist


def balance_classes(df: DataFrame, label: str, key: str = "row_id",
                    seed: int = DEFAULT_SEED, positive=None, negative=None,
                    counts: dict | None = None, hist: dict | None = None) -> DataFrame:
    """M1: keep every row of the smaller class and exactly as many rows of the
    larger one, chosen in ``balance`` hash order. Rows in neither class (null
    target) are dropped. Default classes: ``label > 0`` and ``label = 0``."""
    from tabprep.sources.readers import require_classes

    pos = positive if positive is not None else positive_class(label)
    neg = negative if negative is not None else F.col(label) == 0
    if counts is None:
        counts, hist = class_prefix_counts(df, label, key, seed, "balance", positive, negative)
    require_classes(counts, ["pos", "neg"])
    m = min(counts["pos"], counts["neg"])
    major_name = "pos" if counts["pos"] > counts["neg"] else "neg"
    major, minor = (pos, neg) if major_name == "pos" else (neg, pos)
    first = hist.get(major_name) if hist else None
    keep_major = prefix_condition(df.where(major), m, key, seed, "balance", first_level=first)
    return df.where(minor | (major & keep_major))


def balance_superset(df: DataFrame, label: str, key: str, seed: int, counts: dict,
                     hist: dict, positive=None, negative=None) -> DataFrame:
    """Rows that can be in the balanced set, known from the first-level
    histograms alone: the smaller class, and the larger one up to (and
    including) the prefix that holds its m-th row. :func:`balance_classes`
    over this superset (with the same ``counts`` and ``hist``) gives exactly
    the balanced set, so the source is read once for the counts and once to
    write the superset; the boundary is found on the written rows."""
    from tabprep.sources.readers import require_classes

    pos = positive if positive is not None else positive_class(label)
    neg = negative if negative is not None else F.col(label) == 0
    require_classes(counts, ["pos", "neg"])
    m = min(counts["pos"], counts["neg"])
    major_name = "pos" if counts["pos"] > counts["neg"] else "neg"
    major, minor = (pos, neg) if major_name == "pos" else (neg, pos)
    bp = boundary_prefix(hist.get(major_name, {}), m)
    if bp is None:
        return df.where(minor | major)
    prefix = F.substring(hash_col(key, seed, "balance"), 1, PREFIX_DIGITS)
    return df.where(minor | (major & (prefix <= F.lit(bp))))


def split_sizes(n: int, test_size: float = 0.2) -> tuple[int, int]:
    """(n_train, n_test) with ``n_test = ceil(test_size * n)``."""
    n_test = int(math.ceil(test_size * n))
    return n - n_test, n_test


def train_test_split(df: DataFrame, test_size: float = 0.2, key: str = "row_id",
                     seed: int = DEFAULT_SEED, n: int | None = None):
    """M4: exact split; the first ``ceil(test_size * n)`` rows in ``split``
    hash order are the test set. Returns ``Splits(train, test)``."""
    from tabprep.splits import Splits

    if n is None:
        n = df.count()
    _, n_test = split_sizes(n, test_size)
    in_test = prefix_condition(df, n_test, key, seed, "split")
    return Splits(df.where(~in_test), df.where(in_test))
