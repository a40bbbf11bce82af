"""Secret scan with corpus-wide ownership frequency (native).

Three base patterns give the candidate spans of each text, ``BARE`` adds
long mixed tokens without a keyword before them. Every candidate *value* is
hashed, and the hashes of the whole corpus are counted by distinct owners and
repositories: a value that many owners carry is a widely copied example, one
that a single owner has and that looks random is a live-looking credential.

Base spans are always reported (with their class); a bare token becomes a
``live`` span only if its value is owner-specific or is a base value elsewhere
that is not an example.

Spans are found with built-in functions: one scan lists the matches of each text with
the lengths of the gaps between them (``split``). Everything further works on the
matches, one row each: distinct ones per text, offsets by running sums, bare tokens
that overlap base spans by running extremes. So the work is linear in the matches of a
text, and no text is shuffled.

Counting never gathers a value's documents: rows are reduced to distinct
(hash, owner, repository), then to (hash, owner), then to the hash, each with a
map-side partial aggregate, so a value in a third of all rows is one partial
row per task.

Defined results: a null text is an empty one (no span); a null owner or
repository counts as one unknown owner or repository; equal texts have equal
spans; repeated rows stay repeated; other columns are not read (:func:`redact` keeps
them, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.common import quoted, small_or_shuffled, text_key, whole_rows
from tabprep.session import materialize

# The base patterns, the group that holds the value and its least length.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 16)
HEX = (r"[0-9a-f]+", 0, 32)
#: Long tokens without a keyword; kept if letters and digits are mixed.
BARE = (r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
BASE_KINDS = ["assign", "access", "hex"]
PATTERNS, BARE_RANK = [ASSIGN, ACCESS, HEX, BARE], 3
#: Distinct owners, or repositories, from which on a value is a widely copied example.
WIDE_OWNERS, WIDE_REPOS = 5, 10
#: Owners and repositories up to which a value is owner-specific.
OWN_OWNERS, OWN_REPOS = 1, 3
#: Distinct characters that a live-looking value has at least.
LIVE_CHARS = 10


EMPTY = "array<struct<rank:int,pos:int,gap:int,len:int,value:string>>"


def _matches(text: str, rank: int) -> Column:
    """The leftmost non-overlapping matches of one kind with the length of the gap
    before each (code points)."""
    regex, group, least = PATTERNS[rank]
    # hex runs are maximal, so shorter ones need not be listed to be dropped
    whole = r"[0-9a-f]{%d,}" % least if PATTERNS[rank] is HEX else regex
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(whole), F.lit(0))
    values = F.regexp_extract_all(t, F.lit(whole), F.lit(group)) if group else found
    gaps = F.split(t, whole, -1)
    rows = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    return F.when(t.rlike(whole), F.transform(rows, lambda r, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("pos"), F.char_length(r["g"]).alias("gap"),
        F.char_length(r["m"]).alias("len"), r["v"].alias("value")))).otherwise(F.array().cast(EMPTY))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
         repo: str = "lang") -> DataFrame:
    """``doc_id, tkey, owner, repo, found``: the matches of each document row."""
    own = F.coalesce(F.col(owner).cast("string"), F.lit("?"))
    d = docs.select(F.col(doc_id).alias("doc_id"), own.alias("owner"),
                    F.concat_ws("/", own, F.coalesce(F.col(repo).cast("string"), F.lit("?"))).alias("repo"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.select("doc_id", text_key("text", "doc_id").alias("tkey"), "owner", "repo",
                    F.concat(*[_matches("text", k) for k in range(len(PATTERNS))]).alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """``tkey, rank, start, end, value``: the base spans of each distinct text, and its
    bare tokens (letters and digits mixed) outside them."""
    each = scanned.filter(F.size("found") > 0).select("tkey", F.inline("found")).distinct().repartition("tkey")
    so_far = Window.partitionBy("tkey", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int"))
    least = F.lit(None).cast("int")
    for rank, (_, _, n) in enumerate(PATTERNS):
        least = F.when(F.col("rank") == rank, n).otherwise(least)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    each = each.select("tkey", "rank", (F.col("end") - F.col("len")).alias("start"), "end", "value").filter(
        (F.char_length("value") >= least) & ((F.col("rank") < BARE_RANK) | mixed))
    base = F.col("rank") < BARE_RANK
    upto = Window.partitionBy("tkey").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy("tkey").orderBy(F.col("start").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("ended", F.max(F.when(base, F.col("end"))).over(upto)).withColumn(
        "begun", F.min(F.when(base, F.col("start"))).over(since))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("begun") >= F.col("end"), F.lit(True))
    return each.filter(base | free).drop("ended", "begun")


def ownership(scanned: DataFrame, found: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS,
              own_owners: int = OWN_OWNERS, own_repos: int = OWN_REPOS, live_chars: int = LIVE_CHARS) -> DataFrame:
    """One row per value hash: ``hash, owners, repos, in_base, random, class``
    (``example``, ``live`` or ``shared``) from the scan and its spans."""
    holders = scanned.filter(F.size("found") > 0).select("tkey", "owner", "repo").distinct()
    # many distinct characters: the value looks random
    random = F.size(F.array_distinct(F.split("value", ""))) >= live_chars
    values = found.select("tkey", F.sha2("value", 256).alias("hash"), (F.col("rank") < BARE_RANK).alias("in_base"),
                          random.alias("random")).distinct()
    flags = [F.max("in_base").alias("in_base"), F.max("random").alias("random")]
    per_repo = values.join(holders, "tkey").groupBy("hash", "owner", "repo").agg(*flags)
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), *flags)
    per_hash = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), *flags)
    wide = (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)
    own = (F.col("owners") <= own_owners) & (F.col("repos") <= own_repos) & F.col("random")
    return per_hash.withColumn("class", F.when(wide, "example").when(own, "live").otherwise("shared"))


def _verdicts(docs: DataFrame, doc_id: str, text: str, owner: str, repo: str, **limits) -> tuple[DataFrame, DataFrame]:
    """The written scan, and the spans with ``hash``, ``class`` and whether they are
    reported (base spans) or ``live`` (added)."""
    scanned = materialize(scan(docs, doc_id, text, owner, repo), "secret-scan")
    found = materialize(spans(scanned), "secret-spans")
    classes = ownership(scanned, found, **limits).select("hash", "class", F.col("in_base").alias("known"))
    seen = found.withColumn("hash", F.sha2("value", 256)).join(classes, "hash")
    live = (F.col("class") == "live") | F.col("known") & (F.col("class") != "example")
    return scanned, seen.withColumn("live", (F.col("rank") == BARE_RANK) & live)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
                 repo: str = "lang", **limits) -> DataFrame:
    """One row per document row: ``doc_id, tkey, base, live, classes``.

    ``base`` are the base spans (by start, then kind), ``live`` the added ones,
    ``classes`` the class of each distinct base value hash of the text. The scan
    (matches only, no texts) is written once and read by the counts and the result."""
    scanned, seen = _verdicts(docs, doc_id, text, owner, repo, **limits)
    base = F.col("rank") < BARE_RANK
    kind = F.element_at(F.array(*[F.lit(k) for k in BASE_KINDS]), F.col("rank") + 1)
    # written, so that the join with all documents has a known side to broadcast
    # or, beyond, two shuffles of which a hot text's partition can be split
    per_text = materialize(seen.groupBy("tkey").agg(
        F.sort_array(F.collect_list(F.when(base, F.struct("start", "rank", "end", kind.alias("kind"), "value")))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("start", "end")))).alias("live"),
        F.sort_array(F.collect_set(F.when(base, F.struct("hash", "class")))).alias("classes")), "secrets")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return scanned.select("doc_id", "tkey").join(per_text, "tkey", "left").select(
        "doc_id", "tkey", none("base", "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"),
        none("live", "array<struct<start:int,end:int>>"), none("classes", "array<struct<hash:string,class:string>>"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", owner: str = "source",
           repo: str = "lang", **limits) -> DataFrame:
    """``docs`` with the spans of live-looking and shared values replaced by
    ``mark`` (one for spans that overlap); widely copied examples stay. All columns are
    kept, whatever their names; null texts stay null."""
    _, seen = _verdicts(docs, doc_id, text, owner, repo, **limits)
    gone = seen.filter(F.col("live") | (F.col("rank") < BARE_RANK) & (F.col("class") != "example"))
    before = Window.partitionBy("tkey").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("tkey").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    gone = gone.select("tkey", "start", "end", F.max("end").over(before).alias("ended")).withColumn(
        "part", F.sum(F.when(F.col("start") < F.col("ended"), 0).otherwise(1)).over(upto))
    cuts = gone.groupBy("tkey", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("tkey").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = materialize(cuts, "secret-cuts")
    rows = whole_rows(docs, tkey=text_key(F.coalesce(quoted(text), F.lit("")), quoted(doc_id)))
    rows = rows.join(small_or_shuffled(cuts, cuts.count()), "tkey", "left")
    # four bytes a character, so that a piece is found by its offset; the lambda's
    # variable keeps the encoded text from being made anew for every piece
    whole = F.array(F.struct(F.encode(F.coalesce(F.col("row")[text], F.lit("")), "UTF-32").alias("u"), F.col("cuts").alias("c")))

    def pieces(z: Column) -> Column:
        at = lambda i: F.when(i == 0, 0).otherwise(F.get(z["c"], i - 1)["end"])
        cut = lambda start, length: F.decode(F.substring(z["u"], 4 * start + 1, 4 * length), "UTF-32")
        head = F.transform(z["c"], lambda s, i: cut(at(i), s["start"] - at(i)))
        last = F.element_at(z["c"], -1)["end"]
        return F.array_join(F.concat(head, F.array(F.decode(F.substring(z["u"], 4 * last + 1, F.length(z["u"])), "UTF-32"))), mark)

    changed = F.when(F.size("cuts") > 0, F.get(F.transform(whole, pieces), 0)).otherwise(F.col("row")[text])
    return rows.withColumn("changed", changed).select(*[
        F.col("changed").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
