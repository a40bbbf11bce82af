"""Cross-tokenizer alignment by pointer jumping.

A text is encoded by two tokenizers: A, a byte-level BPE file, over a space and
the text, and B, a SentencePiece file that puts the space itself. Byte offsets
where tokens of both end cut the tokens into groups. To find them, every token
points to its farthest-right overlapping token - a token of A to the one of B that
holds its last byte, a token of B to the one of A there if that ends later, else
to itself - and successors are doubled (``next = next[next]``) for all tokens at
once until nothing changes. What a token points to then is its component's
terminal token, the label of its group; the number of rounds is logarithmic in the
longest chain.

Tokens of both kinds always end where a unit ends (:mod:`units`), so tasks encode and
align the distinct units of their texts, a block of new units at a time, and a text's
groups are those of its units. A link is a pair of occurrences in one group; the
links of a unit are kept as id pairs with multiplicities.

One pass encodes and aligns: it writes every text's figures, groups, and distinct
linked id pairs with multiplicities. The corpus count of an id pair is the number of
texts that hold it linked. Tasks count the written pairs and merge before they send;
a grouped sum makes a written table. Another pass over the written pairs looks up the
counts of those with a share of at least ``HEAVY_SHARE`` (so a bounded number is
broadcast, and no shuffled key is hot) and the highest count of every id of A (bounded
by the vocabulary); the rare rest is joined with the table by a shuffle.

Special tokens' strings are plain text. A text that is null or empty, or whose
tokens of A or B do not join to a space and the text, has no tokens: zeros and
no groups. Repeated rows are texts of their own and stay repeated; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tabprep.llm import units
from tabprep.llm.byte_pairs import TOKENIZER, alphabet
from tabprep.llm.pieces import FILE_SPACE, MODEL
from tabprep.session import materialize

#: Share of all (text, pair) rows from which a pair's count is broadcast.
HEAVY_SHARE = 5e-7
#: Id pairs expanded, or looked up, at a time, and pair counts kept before a flush.
EXPANDED, HELD_PAIRS = 2_000_000, 1_500_000
#: Characters of new units that are aligned at a time.
ALIGN_CHARS = 200_000
#: Characters of text whose units are numbered before the new ones are worked on.
ROUND_CHARS = 2_000_000
#: New units that are encoded as one text.
RUN = 256


class Tokenizers:
    """Both tokenizers in a task, from their files' contents."""

    def __init__(self, source: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(source), SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        byte_of = {c: v for v, c in enumerate(alphabet())}
        self.raw_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        added = self.a.get_added_tokens_decoder()
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.raw_a[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.raw_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(FILE_SPACE, " ").encode()
                      for i, p in enumerate(pieces)]
        crossing = [p for p in pieces if "\n" in p or FILE_SPACE in p.lstrip(FILE_SPACE)]
        if crossing:
            raise ValueError(f"pieces that go on after a space or line end: {crossing[:3]}")
        self.space = self.b.piece_to_id(FILE_SPACE)
        self.size_a = np.array([len(r) for r in self.raw_a], np.int64)
        self.size_b = np.array([len(r) for r in self.raw_b], np.int64)

    def _a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _b(self, texts: list[str]) -> list[list[int]]:
        """Each begins with the space that B puts before a text, or with a line end,
        which no piece goes beyond."""
        ids = self.b.encode([u[1:] if u[0] == " " else u for u in texts], num_threads=1)
        return [[self.space] if u == " " else x if u[0] == " " else x[1:] for u, x in zip(texts, ids)]

    def encode(self, fresh: list[str], size: np.ndarray):
        """The ids of units of ``size`` bytes, one after the other, and how many each has,
        for A and for B. Units are encoded in runs, as texts of so many units: their tokens
        end where units do. Runs whose tokens do not are encoded a unit at a time."""
        ends_white = [u[-1].isspace() for u in fresh]
        first = [0]
        for i in range(1, len(fresh)):
            if i - first[-1] >= RUN or ends_white[i] or ends_white[i - 1]:
                first.append(i)
        cuts = np.array([*first, len(fresh)])
        runs = ["".join(fresh[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return (*_per_unit(self._a, self.size_a, runs, fresh, cuts, size),
                *_per_unit(self._b, self.size_b, runs, fresh, cuts, size))


def _per_unit(encode, size_of: np.ndarray, runs: list[str], fresh: list[str], cuts: np.ndarray, size: np.ndarray):
    """The ids of all units and how many each has, from those of runs of units."""
    lists = encode(runs)
    ids, counts = _ragged(lists)
    bytes_of = size_of[ids]
    bad = units.sums(bytes_of, counts) != units.sums(size, np.diff(cuts))
    if not bad.any():
        unit_ends, ends = np.cumsum(size), np.cumsum(bytes_of)
        at = np.searchsorted(ends, unit_ends)
        off = np.flatnonzero(ends[at] != unit_ends)
        if not len(off):
            return ids, np.diff(at, prepend=-1)
        bad[np.searchsorted(cuts, off, side="right") - 1] = True
    singles = []
    for a, b, run, again in zip(cuts[:-1].tolist(), cuts[1:].tolist(), lists, bad.tolist()):
        if again and b - a > 1:
            singles += encode(fresh[a:b])
        elif b - a == 1:
            singles.append(run)
        else:
            ends = np.cumsum(size_of[np.array(run, np.int64)])
            at = np.searchsorted(ends, np.cumsum(size[a:b])) + 1
            if (ends[at - 1] != np.cumsum(size[a:b])).any():
                singles += encode(fresh[a:b])
            else:
                singles += [run[i:j] for i, j in zip([0, *at.tolist()], at.tolist())]
    return _ragged(singles)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token of A, then of B, given by their ascending byte ends, the
    terminal token of its component: the place in B of the token with its group's end."""
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a)               # the token of B that holds the last byte
    to_a = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    succ = np.concatenate((n + to_b, np.where(ends_a[to_a] > ends_b, to_a, own)))
    while True:
        further = succ[succ]
        if (further == succ).all():
            return succ - n
        succ = further


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _joined(raw: list[bytes], ids: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(map(raw.__getitem__, ids.tolist())), np.uint8)


def _texts(size: int, separators: str) -> np.ndarray:
    """The decimal ids, each followed by the first separator, then by the second."""
    return np.array([f"{i}{s}" for s in separators for i in range(size)], object)


def _distinct(group: np.ndarray, ids: np.ndarray):
    """The distinct ids of each group, with multiplicities."""
    span = np.int64(ids.max() + 1)
    key, n = summed(group * span + ids, np.ones(len(ids), np.int64))
    return *np.divmod(key, span), n


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of ``n``."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[order], first)


class Aligner:
    """Aligns texts; remembers the groups and links of their units."""

    def __init__(self, source: str, model: bytes):
        self.both = Tokenizers(source, model)
        self.size_a, self.size_b = self.both.size_a, self.both.size_b
        self.width = len(self.size_b)                    # an id pair is a * width + b
        self.text_a, self.text_b = _texts(len(self.size_a), ",|"), _texts(len(self.size_b), ",;")
        self._forget()

    def _forget(self):
        self.numbers, self.lines = units.Numbers(), []
        self.pairs, self.times = units.Ragged(), units.Grown(np.int64)  # links of a unit: id pairs and how often
        self.facts = units.Grown(np.int64, (5,))         # valid, tokens of A and B, groups, links

    def _learn(self):
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for a, b in units.blocks(fresh, ALIGN_CHARS):
            self._align(fresh[a:b])

    def _align(self, fresh: list[str]):
        wanted = [u.encode() for u in fresh]
        ids_a, n_a, ids_b, n_b = self.both.encode(fresh, np.fromiter(map(len, wanted), np.int64, len(wanted)))
        valid = self._valid(wanted, ids_a, n_a, ids_b, n_b)
        if not valid.all():
            ids_a, ids_b = ids_a[np.repeat(valid, n_a)], ids_b[np.repeat(valid, n_b)]
            n_a, n_b = n_a * valid, n_b * valid
        end = terminals(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])) if len(ids_a) else ids_a
        terminal = np.zeros(len(ids_b), np.int64)
        terminal[end] = 1
        labels, group = np.flatnonzero(terminal), (np.cumsum(terminal) - 1)[end]
        group_a, group_b = group[: len(ids_a)], group[len(ids_a):]
        n_groups = len(labels)
        of_unit = np.repeat(np.arange(len(fresh)), n_b)[labels]
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        facts = np.zeros((len(fresh), 5), np.int64)
        facts[:, 0], facts[:, 1], facts[:, 2] = valid, n_a, n_b
        facts[:, 3] = np.bincount(of_unit, minlength=len(fresh))
        facts[:, 4] = np.bincount(of_unit, in_a * in_b, len(fresh))
        self.lines += self._lines(ids_a, ids_b, in_a, in_b, group_a, group_b, n_a + n_b)
        unit, pair, n = self._links(group_a, ids_a, group_b, ids_b, of_unit)
        self.pairs.add(pair, np.bincount(unit, minlength=len(fresh)))
        self.times.add(n)
        self.facts.add(facts)

    def _valid(self, wanted: list[bytes], ids_a, n_a, ids_b, n_b) -> np.ndarray:
        """Which units both token sequences join to."""
        size = np.fromiter(map(len, wanted), np.int64, len(wanted))
        valid = (units.sums(self.size_a[ids_a], n_a) == size) & (units.sums(self.size_b[ids_b], n_b) == size)
        want = np.frombuffer(b"".join([w for w, v in zip(wanted, valid) if v]), np.uint8)
        other = ((want != _joined(self.both.raw_a, ids_a[np.repeat(valid, n_a)]))
                 | (want != _joined(self.both.raw_b, ids_b[np.repeat(valid, n_b)])))
        sized = np.flatnonzero(valid)
        valid[sized[np.unique(np.searchsorted(np.cumsum(size[sized]), np.flatnonzero(other), side="right"))]] = False
        return valid

    def _lines(self, ids_a, ids_b, in_a, in_b, group_a, group_b, tokens) -> list[str]:
        """The groups of each unit as text: the ids of A, then those of B, group by group."""
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        i, j = np.arange(len(ids_a)), np.arange(len(ids_b))
        parts = np.empty(len(ids_a) + len(ids_b), object)
        parts[i + (upto_b - in_b)[group_a]] = self.text_a[ids_a + (i == upto_a[group_a] - 1) * len(self.size_a)]
        parts[j + upto_a[group_b]] = self.text_b[ids_b + (j == upto_b[group_b] - 1) * len(self.size_b)]
        flat, ends = parts.tolist(), np.cumsum(tokens).tolist()
        return ["".join(flat[a:b])[:-1] for a, b in zip([0, *ends], ends)]

    def _links(self, group_a, ids_a, group_b, ids_b, of_unit):
        """``(unit, id pair, multiplicity)`` of all groups, summed per unit. Groups are
        expanded over their distinct ids, a bounded number of pairs at a time (or one group)."""
        if not len(of_unit):
            return group_a, ids_a, ids_a
        ga, a, ma = _distinct(group_a, ids_a)
        gb, b, mb = _distinct(group_b, ids_b)
        size_a, size_b = np.bincount(ga, minlength=len(of_unit)), np.bincount(gb, minlength=len(of_unit))
        first_b = np.cumsum(size_b) - size_b
        ends = np.cumsum(size_b[ga])                     # pairs up to each distinct id of A
        units_, keys, times, done = [], [], [], 0
        while done < len(ga):
            last = max(done + 1, int(np.searchsorted(ends, ends[done] - size_b[ga[done]] + EXPANDED, side="right")))
            mine = np.arange(done, last)
            n = size_b[ga[mine]]
            left = np.repeat(mine, n)
            right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first_b[ga[left]]
            pair, m = a[left] * self.width + b[right], ma[left] * mb[right]
            span = np.int64(len(self.size_a)) * self.width
            key, m = summed(of_unit[ga[left]] * span + pair, m)
            units_.append(key // span)
            keys.append(key % span)
            times.append(m)
            done = last
        unit, pair, m = (np.concatenate(x) for x in (units_, keys, times))
        order = np.argsort(unit, kind="stable")          # a unit cut in two may name a pair twice; sums do not mind
        return unit[order], pair[order], m[order]

    def texts(self, texts: list[str]):
        """Blocks ``(first, last, units, how many per text, facts)`` of texts. A text
        with tokens that do not join to it has all facts zero, and no units."""
        if self.numbers.full:
            self._forget()
        done = []
        for a, b in units.blocks(texts):
            which, counts = self.numbers.of([units.UNIT.findall(" " + t) if t else [] for t in texts[a:b]])
            done.append((a, b, which.astype(np.int32), counts))
        if self.numbers.fresh:
            self._learn()
        for a, b, which, counts in done:
            facts = units.sums(self.facts.all[which], counts) if len(which) else np.zeros((b - a, 5), np.int64)
            bad = facts[:, 0] != counts
            if bad.any():
                facts[bad] = 0
                which, counts = which[~np.repeat(bad, counts)], np.where(bad, 0, counts)
            yield a, b, which, counts, facts

    def per_text(self, which: np.ndarray, counts: np.ndarray, lists: units.Ragged, times: np.ndarray):
        """The distinct id pairs of each text ``(text, pair, multiplicity)`` from those of its units."""
        owner = np.repeat(np.arange(len(counts)), counts)
        span = np.int64(len(self.numbers))
        key, n = summed(owner * span + which, np.ones(len(which), np.int64))
        owner, unit = np.divmod(key, span) if len(key) else (key, key)
        at, sizes = lists.places(unit)
        span = np.int64(len(self.size_a)) * self.width
        key, n = summed(np.repeat(owner, sizes) * span + lists.flat.all[at], np.repeat(n, sizes) * times[at])
        return *np.divmod(key, span), n


def _aligner(files):
    """Per text the figures, the groups, and the distinct id pairs linked, with multiplicities."""
    def run(batches):
        aligner = Aligner(*files.value)
        for rows in batches:
            sizes = compute.utf8_length(rows.column(1)).to_pylist()
            for first, last in units.cuts(sizes, ROUND_CHARS):
                mine = rows.slice(first, last - first)
                for a, b, which, counts, facts in aligner.texts(mine.column(1).to_pylist()):
                    cuts, numbers = [0, *np.cumsum(counts).tolist()], which.tolist()
                    lines = [";".join([aligner.lines[u] for u in numbers[i:j]]) for i, j in zip(cuts, cuts[1:])]
                    owner, pair, n = aligner.per_text(which, counts, aligner.pairs, aligner.times.all)
                    yield pa.RecordBatch.from_arrays(
                        [mine.column(0).slice(a, b - a), *(pa.array(facts[:, k]) for k in range(1, 5)),
                         pa.array(lines, pa.string()), _pair_lists(pair, n, np.bincount(owner, minlength=b - a))],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
    return run


def _pair_lists(pair: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pair), pa.array(n)], ["pair", "m"]))


def _lists_of(column: pa.ListArray):
    """What :func:`_pair_lists` has made a column of, some rows at a time: ``(first, last, pair, n, sizes)``."""
    sizes = compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in units.cuts(sizes.tolist(), EXPANDED):
        pair, n = (x.to_numpy() for x in column.slice(a, b - a).flatten().flatten())
        yield a, b, pair, n, sizes[a:b]


def _count_pairs(batches):
    """The number of texts that hold each id pair linked, merged in the task."""
    held, size = [], 0

    def batch(parts):
        return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    for rows in batches:
        for _, _, pair, _, _ in _lists_of(rows.column(0)):
            held.append(summed(pair, np.ones(len(pair), np.int64)))
            size += len(held[-1][0])
            if size > 2 * HELD_PAIRS:
                held = [batch(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
                    size = 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in batch(held)], ["pair", "n"])


def _looker(tables, width: int):
    """Beside the columns before ``links``, the last one: what the broadcast pairs give, and the rare pairs to join."""
    def run(batches):
        known, count, best = tables.value                # pairs in order, their counts, best count of each id of A
        for rows in batches:
            for a, b, pair, n, sizes in _lists_of(rows.column(rows.num_columns - 1)):
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                heavy = known[at] == pair
                of = np.where(heavy, count[at], 0)
                top = np.where(heavy & (of == best[pair // width]), n, 0)
                left = np.bincount(np.repeat(np.arange(b - a), sizes)[~heavy], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in rows.columns[:-1]), pa.array(units.sums(top, sizes)),
                     pa.array(units.sums(of * n, sizes)), _pair_lists(pair[~heavy], n[~heavy], left)],
                    [*rows.schema.names[:-1], "heavy_best", "heavy_sum", "rare"])
    return run


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
           model: str = MODEL) -> DataFrame:
    """One row per document row: ``doc_id, n_a, n_b, n_groups, n_links, groups`` and ``links``, its distinct id
    pairs ``pair`` (``a * size of B's vocabulary + b``) with multiplicities ``m``."""
    files = docs.sparkSession.sparkContext.broadcast(_files(tokenizer, model))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.mapInArrow(_aligner(files), f"doc_id {dict(d.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, "
                                         "n_links long, groups string, links array<struct<pair:long,m:long>>")


def link_counts(found: DataFrame) -> DataFrame:
    """The corpus count of every id pair of rows with ``links``: ``pair``, ``n``."""
    return (found.select("links").mapInArrow(_count_pairs, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def _files(tokenizer: str, model: str) -> tuple[str, bytes]:
    """The files' contents, read on the driver (bounded by the vocabularies)."""
    with open(tokenizer, encoding="utf-8") as a, open(model, "rb") as b:
        return a.read(), b.read()


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, model: str = MODEL,
          groups: Column | None = None, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document row: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups`` with the groups as text, ``a1,a2|b1;a3|b2,b3``, or what the
    column expression ``groups`` over the column of that name makes of them."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    source, proto = _files(tokenizer, model)
    both = Tokenizers(source, proto)
    width, n_ids = len(both.raw_b), len(both.raw_a)
    found = linked(docs, doc_id, text, tokenizer, model)
    found = materialize(found.withColumn("groups", F.col("groups") if groups is None else groups), "linked")
    counts = materialize(link_counts(found).withColumn("a", F.expr(f"cast(pair div {width} as int)")), "link-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))          # one row per id of A at most
    top = best.toPandas()
    highest = np.zeros(n_ids, np.int64)
    highest[top.a.to_numpy(np.int64)] = top.best.to_numpy(np.int64)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1.0, heavy_share * total)
    heavy = counts.filter(F.col("n") >= least).select("pair", "n").toPandas()  # at most 1 / heavy_share rows
    keys = heavy.pair.to_numpy(np.int64)
    order = np.argsort(keys)
    tables = (np.append(keys[order], np.iinfo(np.int64).max), np.append(heavy.n.to_numpy(np.int64)[order], 0), highest)
    schema = StructType(found.drop("links").schema.fields).add("heavy_best", "long").add("heavy_sum", "long").add(
        "rare", ArrayType(StructType().add("pair", "long").add("m", "long")))
    found = found.mapInArrow(_looker(sc.broadcast(tables), width), schema)
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    rare = (found.select("row", F.inline("rare"))
            .join(counts.filter(F.col("n") < least), "pair").join(F.broadcast(best), "a")
            .groupBy("row").agg(F.sum(F.col("m") * F.col("n")).alias("rare_sum"),
                                F.sum(F.when(F.col("n") == F.col("best"), F.col("m")).otherwise(0)).alias("rare_best")))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("heavy_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("heavy_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups")
