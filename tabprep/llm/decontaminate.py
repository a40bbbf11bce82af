"""Benchmark decontamination by a prefix-filtered set join (native).

Every benchmark window (``window`` consecutive item words; the whole item if it
is shorter) is a set of word shingles. A document contains the window only if
it contains *all* its shingles, so for containment 1 the necessary prefix of
the rarity-ordered shingles has length 1: the rarest shingle. The plan:

1. one pass over the documents keeps the word positions whose shingle occurs in
   some window, with the digest of the words that a window there would have
   (one row per document besides, for the word counts), and writes them;
2. shingles are ordered by their counts over all documents, and each window
   keeps its rarest one (a window with a shingle that no document has is out);
3. document shingles are joined with these prefix shingles, under the
   positional and length bounds (the window must fit around the shingle);
4. the whole window is verified at its start by its digest (128 bits).

Texts are split into words once, nothing but matching positions is shuffled,
and copies of a text are looked up once. The shingle table is broadcast only
when its counted size is below ``broadcast_rows``; beyond, a Bloom filter of bounded
size takes its place in the scan, and what passes is joined with it by a shuffle.

Defined results: a null or empty text has no words and no hit; an item without
words has no window; an item without an id is left out; equal texts get equal
results and repeated rows stay repeated; only the named columns are read, so
other columns cannot clash; empty tables give an empty (or all-clean) result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import ALNUM_GAP, BROADCAST_ROWS, ascii_lower, text_key, without_texts, words
from tabprep.llm.urlfilter import BITS_PER_URL, HASHES, _block, _mask
from tabprep.session import materialize

WINDOW = 10
SHINGLE = 5
#: 64-bit words of the Bloom filter of a large shingle table at most (16 MB).
MAX_BLOCKS = 1 << 20


def word_array(text) -> Column:
    return words(ascii_lower(text), ALNUM_GAP)


def _shingle(arr: str, at, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(arr), at + F.lit(i)) for i in range(size)])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """``(item_id, wid, ww)``: each item's distinct windows as word arrays."""
    items = (benchmark.select(F.col(item_id).alias("item_id"), word_array(text).alias("w"))
             .filter(F.col("item_id").isNotNull() & (F.size("w") > 0)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    out = (items.select("item_id", "w", F.explode(starts).alias("s"))
           .select("item_id", F.expr(f"slice(w, s + 1, {window})").alias("ww")))
    return out.withColumn("wid", F.md5(F.array_join("ww", " "))).dropDuplicates(["item_id", "wid"])


def _digest(arr: str, at, length: int) -> Column:
    return F.md5(F.array_join(F.slice(F.col(arr), at + 1, length), " "))


def _possible(at: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """The positions whose ``key`` passes a blocked Bloom filter of ``keys``, a broadcast
    table of at most ``MAX_BLOCKS`` words."""
    blocks = max(1, min(MAX_BLOCKS, n_keys * BITS_PER_URL // 64))
    bloom = keys.select(_block("key", blocks), _mask("key", HASHES).alias("mask")).groupBy("block").agg(
        F.bit_or("mask").alias("word"))
    want = _mask("key", HASHES)
    return (at.withColumn("block", _block("key", blocks)).join(F.broadcast(bloom), "block")
            .filter(F.col("word").bitwiseAND(want) == want))


def candidate_positions(docs: DataFrame, grams: DataFrame, sizes: list[int], lengths: list[int],
                        small: bool, n_grams: int = 0) -> DataFrame:
    """``(doc_id, tkey, n, pos, k, key, digests)``: the positions of ``docs(doc_id, tkey, w)``
    whose shingle of ``k`` words is in ``grams``, and one row without key per document row.
    Without a ``small`` shingle table the positions pass a Bloom filter of it in the scan and
    only those that do are shuffled, with their digests and without the words."""
    out = None
    digests = F.array(*[_digest("w", F.col("pos"), n) for n in lengths])
    for k in sizes:
        keys = grams.filter(F.col("k") == k).select("key", F.lit(k).alias("k")).distinct()
        # the outer form keeps documents without words, and no filter on the words is inferred
        at = docs.select("doc_id", "tkey", "w", F.posexplode_outer("w").alias("pos", "_word")).select(
            "doc_id", "tkey", "w", "pos", _shingle("w", F.col("pos"), k).alias("key"))
        if small:
            rows = at.join(F.broadcast(keys), "key", "left")
            marker = F.coalesce(F.col("pos") == 0, F.lit(True))
            rows = rows.filter(F.col("k").isNotNull() & F.col("pos").isNotNull() | (marker if k == sizes[0] else F.lit(False)))
            known = F.col("k").isNotNull() & F.col("pos").isNotNull()
            rows = rows.select("doc_id", "tkey", F.size("w").alias("n"), "pos", F.when(known, F.col("k")).alias("k"),
                               F.when(known, F.col("key")).alias("key"), F.when(known, digests).alias("digests"),
                               (marker if k == sizes[0] else F.lit(False)).alias("marker"))
        else:
            rows = _possible(at.filter("pos is not null"), keys, n_grams).select(
                "doc_id", "tkey", F.size("w").alias("n"), "pos", F.lit(k).alias("k"), "key", digests.alias("digests"),
                F.lit(False).alias("marker")).join(keys.select("key"), "key", "left_semi")
            if k == sizes[0]:
                none = lambda t: F.lit(None).cast(t)
                rows = rows.unionByName(docs.select(
                    "doc_id", "tkey", F.size("w").alias("n"), F.lit(0).alias("pos"), none("int").alias("k"),
                    none("long").alias("key"), none("array<string>").alias("digests"), F.lit(True).alias("marker")))
        out = rows if out is None else out.unionByName(rows)
    return out


def find_windows(candidates: DataFrame, grams: DataFrame, small: bool) -> DataFrame:
    """Occurrences ``(tkey, start, len, wid)`` of the windows among the candidates."""
    found = candidates.filter("key is not null")
    freq = found.groupBy("key").agg(F.count("*").alias("freq"))
    # the necessary prefix: the rarest shingle of each window
    prefix = (grams.join(freq, "key", "left")
              .groupBy("wid").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key", "off",
                                                 "len", "k")).alias("p"))
              .select("wid", "p.*").filter("freq > 0").drop("freq"))
    texts = found.select("tkey", "n", "pos", "k", "key", "digests").dropDuplicates(["tkey", "pos", "k"])
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    possible = (texts.select("tkey", "n", "pos", "k", "key").join(F.broadcast(prefix) if small else prefix, ["key", "k"])
                .filter(fits).select("tkey", "k", start.alias("start"), "len", "wid").distinct())
    at = texts.select("tkey", "k", F.col("pos").alias("start"), "digests")
    return (possible.join(at, ["tkey", "k", "start"]).filter(F.array_contains("digests", F.col("wid")))
            .select("tkey", "start", "len", "wid"))


#: Words covered by the sorted, possibly overlapping spans ``(start, len)``.
_COVERED = """aggregate(sort_array(spans), named_struct('n', 0L, 'end', 0),
    (a, s) -> named_struct('n', a.n + greatest(s.start + s.len - greatest(a.end, s.start), 0),
                           'end', greatest(a.end, s.start + s.len)), a -> a.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, item_ids`` (sorted
    strings) and ``tkey``, the text's key. See the module docstring for the defined edge cases."""
    windows = materialize(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    distinct = windows.select("wid", "ww", F.size("ww").alias("len")).dropDuplicates(["wid"])
    distinct = distinct.withColumn("k", F.least(F.lit(shingle), F.col("len")))
    shape = distinct.groupBy("k", "len").count().collect()  # at most one row per length up to the window's
    sizes, lengths = sorted({r["k"] for r in shape}) or [shingle], sorted({r["len"] for r in shape}) or [window]
    grams = None
    for k in sizes:
        g = distinct.filter(F.col("k") == k).select("wid", "ww", "len", "k", F.explode(
            F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        g = g.select("wid", "len", "k", "off", _shingle("ww", F.col("off"), k).alias("key"))
        grams = g if grams is None else grams.unionByName(g)
    n_grams = sum(r["count"] * (r["len"] - r["k"] + 1) for r in shape)
    small = n_grams <= broadcast_rows
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = base.select("doc_id", text_key("text", "doc_id").alias("tkey"), word_array("text").alias("w"))
    candidates = materialize(candidate_positions(base, grams, sizes, lengths, small, n_grams), "decontaminate")
    found = find_windows(candidates, grams, small)
    # copies of a text repeat its occurrences: sets remove them map-side
    spans = (found.groupBy("tkey").agg(F.collect_set(F.struct("start", "len")).alias("spans"),
                                       F.collect_set("wid").alias("wids")))
    hits = spans.select("tkey", F.expr(_COVERED).alias("n_hit"), "wids")
    items = (hits.select("tkey", F.explode("wids").alias("wid"))
             .join(windows.select("wid", F.col("item_id").cast("string").alias("item_id")), "wid")
             .groupBy("tkey").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    # written, so that the join with all documents has a counted side to broadcast
    # or, beyond, two shuffles of which a hot text's partition can be split
    per_text = materialize(hits.select("tkey", "n_hit").join(items, "tkey"), "contaminated")
    return (candidates.filter("marker").select("doc_id", "tkey", F.col("n").cast("long").alias("n_words"))
            .join(per_text, "tkey", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "tkey"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      **options) -> DataFrame:
    """``docs`` (all columns) without the texts that hold a benchmark window."""
    found = contamination(docs, benchmark, doc_id, text, **options)
    keys = materialize(found.filter("n_hit > 0").select("tkey").distinct(), "contaminated")
    return without_texts(docs, keys, text)
