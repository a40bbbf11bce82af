"""Personal data: base patterns and information-theoretic sanitisation.

*Base.* E-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers
are found by pattern in whole texts; their values are the protected entities.

*Disclosure.* A term that keeps company with an entity may give it away even
where the entity itself is masked. With ``N`` distinct texts, ``n(e)`` of them
with entity e, ``n(t)`` with term t and ``n(t, e)`` with t within ``CONTEXT``
words of e, the pointwise mutual information ``log2(N n(t,e) / (n(t) n(e)))``
is compared with the entity's information ``log2(N / n(e))``. The disclosure of
t about e is their ratio: 1 if t occurs only beside e, 0 if it is independent.
The share of t's texts with e is shrunk, ``(n(t,e) + PRIOR_TEXTS m) / (n(t) +
PRIOR_TEXTS)``, to the pooled share m of all pairs with entities of its kind: so
every entity gets a verdict, also one of a single text, and little evidence
discloses less than much (for a word seen once, about one bit less than all).
Terms that reach ``GENERALISE`` for some entity are replaced by a generalised
form (``<word>``, ``<number>``), those that reach ``REMOVE`` are removed, in
every text.

*Plan.* One Arrow pass finds entities and their context words (a bounded number
of rows per occurrence, so no pairs within a group are formed). The number of
texts with a term is one grouped count over the distinct terms of all texts, the
pairs are joined with it. Only the terms
that then disclose something - rare ones, since a frequent term cannot reach the
threshold - are looked up in the texts (equi-joins, broadcast below a counted
number of rows and estimated bytes; beyond, only rows that pass a Bloom filter of the
look-up side's keys are shuffled to it). The last pass marks base spans and the disclosing terms of its text.

Defined results: a null text is an empty one (no span); equal texts count once
in all statistics and have equal spans; repeated rows stay repeated; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import BROADCAST_ROWS, SPACE_GAP, small_or_shuffled, text_key, words
from tabprep.llm.urlfilter import BITS_PER_URL, HASHES, _block, _mask
from tabprep.operators.joins import row_bytes
from tabprep.session import materialize

KINDS = ["email", "ip", "card", "phone", "term"]
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

CONTEXT = 5
#: Texts that the pooled share of a kind counts as.
PRIOR_TEXTS = 1.0
GENERALISE = 0.8
#: Estimated bytes of a look-up side that is broadcast; all of them grow with the corpus.
SIDE_BYTES = 2 * 1024 * 1024
REMOVE = 0.95
#: 64-bit words of a look-up side's Bloom filter at most.
MAX_BLOCKS = 1 << 20


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((2 * int(c)) // 10 + (2 * int(c)) % 10 for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches. The search starts at each ``@``: a
    match has the longest run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m and m.end() > at:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` sorted; kinds are indexes into :data:`KINDS`."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def term_of(word: str) -> str:
    """The term of a word: lower-case, without marks around it."""
    return word.strip(".,;:!?\"'()[]<>#*$%&|").lower()


def text_terms(text: str):
    """The distinct terms of a text as a column: marks beside white space are
    taken off, so are those at both ends."""
    marks = r"""[.,;:!?"'()\[\]<>#*$%&|]+"""
    bare = F.regexp_replace(text, rf"(^|[\x20\x09-\x0D]){marks}", " ")
    bare = F.regexp_replace(bare, rf"{marks}(?=[\x20\x09-\x0D]|$)", "")
    return F.array_distinct(words(F.lower(bare), SPACE_GAP))


def _contexts(context: int):
    """``tkey, text`` -> one row per entity occurrence and distinct nearby term."""
    def run(batches):
        for batch in batches:
            keys, entities, terms = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                if not spans:
                    continue
                cut = [(m.start(), m.end()) for m in WORD.finditer(text)]
                inside = [False] * len(cut)
                where = []
                k = 0
                for s, kind, e in spans:  # both lists are in text order
                    while k and cut[k - 1][1] > s:
                        k -= 1
                    while cut[k][1] <= s:
                        k += 1
                    last = k
                    while last < len(cut) and cut[last][0] < e:
                        inside[last] = True
                        last += 1
                    where.append((k, last, f"{KINDS[kind]}:{text[s:e].lower()}"))
                for first, last, entity in where:
                    near = [*range(max(0, first - context), first), *range(last, min(len(cut), last + context))]
                    found = {term_of(text[slice(*cut[i])]) for i in near if not inside[i]} - {""}
                    for t in sorted(found) or [None]:  # an entity without context still counts
                        keys.append(key)
                        entities.append(entity)
                        terms.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(entities, pa.string()),
                                              pa.array(terms, pa.string())], ["tkey", "entity", "term"])
    return run


def split_by(rows: DataFrame, side: DataFrame, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be among the ``n`` of ``side`` by a Bloom filter, a broadcast
    table of at most ``MAX_BLOCKS`` words, and those whose key is not."""
    blocks = max(1, min(MAX_BLOCKS, n * BITS_PER_URL // 64))
    bloom = side.select(_block(key, blocks), _mask(key, HASHES).alias("mask")).groupBy("block").agg(
        F.bit_or("mask").alias("_word"))
    want = _mask(key, HASHES)
    probed = rows.withColumn("block", _block(key, blocks)).join(F.broadcast(bloom), "block", "left")
    may = F.coalesce(F.col("_word").bitwiseAND(want) == want, F.lit(False))
    return probed.filter(may).select(*rows.columns), probed.filter(~may).select(*rows.columns)


def looked_up(rows: DataFrame, side: DataFrame, n: int, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with the ``n`` rows of ``side``: a broadcast below the limits. Beyond them
    only the rows whose key may be in it are shuffled, not all the texts."""
    if n <= BROADCAST_ROWS and n * row_bytes(side.schema) <= SIDE_BYTES:
        return rows.join(F.broadcast(side), key, how)
    may, rest = split_by(rows, side, n, key)
    met = may.join(side, key, how)
    if how == "inner":
        return met
    return met.unionByName(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name)
                                              for f in side.schema.fields if f.name != key]))


def disclosure(docs: DataFrame, text: str = "text", context: int = CONTEXT, prior_texts: float = PRIOR_TEXTS,
               generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``doc_id, tkey, text`` -> the disclosing terms ``(term, disclosure, action)``
    and ``(tkey, terms)`` of the texts that hold some."""
    spark = docs.sparkSession
    seen = materialize(docs.select("tkey", F.coalesce(F.col(text), F.lit("")).alias("text"))
                       .mapInArrow(_contexts(context), "tkey string, entity string, term string")
                       .distinct(), "personal-context")
    # copies of a text count once: its first row does, by its share among repeated rows
    rows = docs.groupBy("tkey", "doc_id").agg(F.count("*").alias("c")).groupBy("tkey").agg(
        F.sum("c").alias("m"), F.min(F.struct("doc_id", "c")).alias("first"))
    rows = materialize(rows.select("tkey", "m", "first.*"), "personal-keys")
    texts, copied = rows.agg(F.count("*"), F.count(F.when(F.col("m") > 1, 1))).first()
    per_entity = seen.groupBy("entity").agg(F.countDistinct("tkey").alias("n_e"))
    pairs = (seen.filter("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_te"))
             .join(per_entity, "entity").withColumn("kind", F.substring_index("entity", ":", 1)).drop("entity"))
    pairs = materialize(pairs, "personal-pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return (spark.createDataFrame([], "term string, disclosure double, action string"),
                spark.createDataFrame([], "tkey string, terms array<string>"))
    copies = rows.filter("m > 1").select("tkey", F.col("doc_id").alias("_first"), "c")
    weight = F.when(F.col("c").isNull(), 1.0).when(F.col("doc_id").eqNullSafe(F.col("_first")), 1.0 / F.col("c")
                                                   ).otherwise(0.0)
    weighed = (looked_up(docs.select("tkey", "doc_id", "text"), copies, copied, "tkey").select("text", weight.alias("weight"))
               .filter("weight > 0"))
    per_term = (weighed.select("weight", F.explode(text_terms("text")).alias("term"))
                .groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n_t")))
    info = F.log2(F.lit(float(max(texts, 1))) / F.col("n_e"))
    pairs = materialize(per_term.join(small_or_shuffled(pairs, n_pairs, max_bytes=SIDE_BYTES), "term"), "personal-shares")
    pool = pairs.groupBy("kind").agg((F.sum("n_te") / F.sum("n_t")).alias("m"))
    share = (F.col("n_te") + prior_texts * F.col("m")) / (F.col("n_t") + prior_texts)
    terms = (pairs.join(F.broadcast(pool), "kind").withColumn("disclosure", F.when(info > 0, 1 + F.log2(share) / info))
             .groupBy("term").agg(F.max("disclosure").alias("disclosure"))
             .filter(F.col("disclosure") >= generalise)
             .withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")))
    terms = materialize(terms, "personal-disclosing")
    words_of = docs.select("tkey", F.explode(text_terms("text")).alias("term"))
    per_text = (looked_up(words_of, terms.select("term", "action"), terms.count(), "term", "inner")
                .groupBy("tkey").agg(F.sort_array(F.collect_set(F.concat_ws(":", "action", "term"))).alias("terms")))
    return terms, materialize(per_text, "personal-texts")


def all_spans(text: str, terms: list[str] | None) -> list[tuple[int, int, int, str]]:
    """Base spans and those of the text's disclosing terms (``action:term``)
    that are outside them: ``(start, kind, end, action)`` sorted."""
    out = [(s, k, e, "mask") for s, k, e in base_spans(text)]
    if terms:
        actions = dict(t.split(":", 1)[::-1] for t in terms)
        taken, i = sorted((s, e) for s, _, e, _ in out), 0
        for m in WORD.finditer(text):
            action = actions.get(term_of(m[0]))
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if action and not (i < len(taken) and taken[i][0] < m.end()):
                left = m.start() + len(m[0]) - len(m[0].lstrip(".,;:!?\"'()[]<>#*$%&|"))
                out.append((left, 4, left + len(m[0].strip(".,;:!?\"'()[]<>#*$%&|")), action))
    return sorted(out)


def sanitise(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """Entities become their kind, terms are generalised or removed."""
    parts, at = [], 0
    for start, kind, end, action in spans:
        if start < at:
            continue
        parts.append(text[at:start])
        if action == "mask":
            parts.append(f"[{KINDS[kind].upper()}]")
        elif action == "generalise":
            parts.append("<number>" if text[start:end].isdigit() else "<word>")
        at = end
    return "".join(parts) + text[at:]


def _mark(batches):
    for batch in batches:
        lines, clean = [], []
        for text, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = all_spans(text, terms)
            lines.append([f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans])
            clean.append(sanitise(text, spans) if spans else text)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.list_(pa.string())), pa.array(clean, pa.string()),
                                          *batch.columns[2:]], ["spans", "sanitised", *batch.schema.names[2:]])


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT,
                  prior_texts: float = PRIOR_TEXTS, generalise: float = GENERALISE,
                  remove: float = REMOVE) -> DataFrame:
    """One row per document row: ``doc_id, spans`` (``kind:start:end`` in order,
    code points) and ``sanitised`` text."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("tkey", F.md5("text"))
    _, per_text = disclosure(d, "text", context, prior_texts, generalise, remove)
    marked = looked_up(d, per_text, per_text.count(), "tkey").select("text", "terms", "doc_id")
    return marked.mapInArrow(_mark, "spans array<string>, sanitised string, "
                                    f"doc_id {dict(d.dtypes)['doc_id']}").select("doc_id", "spans", "sanitised")
