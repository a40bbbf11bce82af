"""Byte-level BPE encoding and decoding by a pair occurrence index.

Each task numbers the distinct units of its texts (see :mod:`units`) and encodes
every unit once. The new units of a block of texts become one array of symbols -
one per byte, neighbours linked, pre-tokens separated - with an index from every
mergeable pair to *all* its positions in the block. The active ranks are applied in
ascending order: all positions of the pair of one rank are merged, left to right,
and each merge enters the pairs that it makes with its neighbours in the lists of
their ranks; positions whose symbols have changed meanwhile are skipped. A merge
can only make pairs of higher rank (checked when the file is read), so one pass
over the ranks gives what merging each pre-token by itself gives.

Pre-tokens are cut by the public pattern of byte-level files; where a unit has
characters whose class depends on the version of Unicode, the file's library cuts
it (its tables are older than Python's). Tokens come from the index alone. A
special token's string inside a text is that token, as in the file's library, or
plain text if ``specials`` is off.

There is no shuffle; a task remembers units up to a fixed number of characters
(then it begins anew, which changes no result) and works on blocks of texts of a
bounded size.

Defined results: a null text is an empty one, which has no tokens and decodes to
the empty text; repeated rows stay repeated; other columns are not read; an
empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm import units

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of new units that one index holds (or one unit).
INDEX_CHARS = 2_000_000
#: Characters of text whose units are numbered before the new ones are worked on.
ROUND_CHARS = 16_000_000
#: Places of a pair up to which they are merged one by one.
FEW = 6
#: Letters, digits and signs up to U+017F are the same in all versions of Unicode;
#: units of them are cut by this pattern (fixed value: byte-level files' own).
OLD = re.compile("[\x00-\u017f]*")
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Merges(NamedTuple):
    ranks: dict[int, int]        # left id << 32 | right id -> rank
    pairs: list[tuple]           # rank -> (left, right, merged)
    keys: np.ndarray             # the same keys in order, and their ranks
    key_rank: np.ndarray
    symbols: np.ndarray          # byte -> id
    raw: list[bytes]             # id -> the bytes it stands for
    specials: dict[str, int]


def alphabet() -> list[str]:
    """The character that stands for each byte in byte-level files: itself where
    it is visible in Latin-1, else the next of the code points from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    chars = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


def parse(source: str) -> Merges:
    """The merges of a byte-level BPE file (its text)."""
    file = json.loads(source)
    model, cut, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                       "ignore_merges") if model.get(k)]
    odd += [k for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
    if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or file["normalizer"] or odd:
        raise ValueError(f"not a plain byte-level BPE file: {odd or cut}")
    ids = model["vocab"]
    split = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    pairs = [(ids[a], ids[b], ids[a + b]) for a, b in split]
    made: dict[int, int] = {}
    for rank, (a, b, new) in enumerate(pairs):
        if max(made.get(a, -1), made.get(b, -1)) >= rank or new in made:
            raise ValueError(f"merge {rank} comes before one that it needs")
        made[new] = rank
    if any(made.get(x, -1) >= rank for rank, (a, b, _) in enumerate(pairs) for x in (a, b)):
        raise ValueError("a merge comes before one that it needs")
    byte_of = {c: b for b, c in enumerate(alphabet())}
    specials = {t["content"]: t["id"] for t in added}
    raw = [b""] * (max([*ids.values(), *specials.values()]) + 1)
    for token, i in ids.items():
        raw[i] = bytes(byte_of[c] for c in token)
    for token, i in specials.items():
        raw[i] = token.encode()
    ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}
    keys = np.array([*ranks, -1], np.int64)          # never empty; no symbols have this key
    order = np.argsort(keys)
    return Merges(ranks, pairs, keys[order], np.array([*ranks.values(), 0])[order],
                  np.array([ids[c] for c in alphabet()]), raw, specials)


class PairIndex:
    """All positions of every mergeable pair in an array of linked symbols, by the
    rank of the pair. ``size`` symbols belong to pre-tokens of the given sizes; one
    more stands for what is before a first and after a last one."""

    def __init__(self, sym: np.ndarray, sizes: np.ndarray, merges: Merges):
        n = len(sym)
        self.merges, self.sym = merges, np.append(sym, -1)
        self.after, self.before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.cumsum(sizes) - 1
        self.after[last], self.before[last + 1 - sizes] = n, n
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.enter(np.arange(n))
        self.active.sort()

    def enter(self, places: np.ndarray):
        """Put the pairs that begin at these places in the lists of their ranks."""
        key = (self.sym[places] << 32) | self.sym[self.after[places]]
        at = np.searchsorted(self.merges.keys, key)
        at[at == len(self.merges.keys)] = 0
        found = self.merges.keys[at] == key
        rank, places = self.merges.key_rank[at[found]], places[found]
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1 if len(rank) else rank
        first = [0, *cut.tolist()] if len(rank) else []
        for r, a, b in zip(rank[first].tolist(), first, [*first[1:], len(rank)]):
            self._put(r, places[a:b])

    def _put(self, rank: int, places):
        held = self.lists.get(rank)
        if held is None:
            self.lists[rank] = [places]
            heappush(self.active, rank)
        else:
            held.append(places)

    def apply(self):
        """Merge all pairs, the ranks in ascending order."""
        while self.active:
            rank = heappop(self.active)
            places = np.unique(np.concatenate(self.lists.pop(rank)))
            left, right, new = self.merges.pairs[rank]
            if left == right or len(places) <= FEW:  # a place may take the next one's symbol
                self._in_turn(places.tolist(), left, right, new)
            else:
                self._at_once(places, left, right, new)

    def _in_turn(self, places: list[int], left: int, right: int, new: int):
        sym, after, before = self.sym, self.after, self.before
        for i in places:
            j = int(after[i])
            if sym[i] != left or sym[j] != right:
                continue                             # one of the two was merged otherwise
            k, h = int(after[j]), int(before[i])
            sym[i], sym[j], after[i], before[k] = new, -1, k, i
            for at, key in ((h, int(sym[h]) << 32 | new), (i, new << 32 | int(sym[k]))):
                rank = self.merges.ranks.get(key)
                if rank is not None:
                    self._put(rank, np.array([at]))

    def _at_once(self, places: np.ndarray, left: int, right: int, new: int):
        sym, after, before = self.sym, self.after, self.before
        i = places[(sym[places] == left) & (sym[after[places]] == right)]
        j = after[i]
        k = after[j]
        sym[i], sym[j] = new, -1
        after[i], before[k] = k, i
        h = before[i]
        self.enter(np.concatenate((i, h[h < len(sym) - 1])))

    def symbols(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left, and how much of it each pre-token has."""
        alive = self.sym[:-1] >= 0
        return self.sym[:-1][alive].astype(np.int32), units.sums(alive.astype(np.int64), sizes)


def merge_all(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of pre-tokens, one after the other, and how many each has."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    index = PairIndex(merges.symbols[np.frombuffer(b"".join(pieces), np.uint8)], sizes, merges)
    index.apply()
    return index.symbols(sizes)


class Encoder:
    """Encodes texts; remembers the tokens of their units."""

    def __init__(self, source: str, specials: bool = True):
        from tokenizers import Tokenizer

        self.merges = parse(source)
        self.cut = Tokenizer.from_str(source).pre_tokenizer.pre_tokenize_str
        marks = sorted(self.merges.specials, key=len, reverse=True) if specials else []
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self._forget()

    def _forget(self):
        self.numbers, self.ids = units.Numbers(), units.Ragged(np.int32)

    def units_of(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return units.UNIT.findall(text)
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else units.UNIT.findall(part)
        return out

    def _pre_tokens(self, unit: str) -> list[bytes]:
        if OLD.fullmatch(unit):
            return [p.encode() for p in PRE_TOKEN.findall(unit)]
        return [unit[a:b].encode() for _, (a, b) in self.cut(unit)]

    def _learn(self):
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for a, b in units.blocks(fresh, INDEX_CHARS):
            seen: dict[bytes, int] = {}
            which, parts = [], []
            for u in fresh[a:b]:
                cut = [u] if self.marks and u in self.merges.specials else self._pre_tokens(u)
                which += [seen.setdefault(p, len(seen)) for p in cut]
                parts.append(len(cut))
            # a special token is a pre-token of its own, which no merge touches
            words = [p if isinstance(p, bytes) else b"\n" for p in seen]
            ids, sizes = merge_all(words, self.merges)
            tokens = units.Ragged(np.int32)
            tokens.add(ids, sizes)
            for p, n in seen.items():
                if isinstance(p, str):
                    tokens.flat.all[tokens.first.all[n]] = self.merges.specials[p]
            at, sizes = tokens.places(np.array(which, np.int64))
            self.ids.add(tokens.flat.all[at], units.sums(sizes, np.array(parts, np.int64)))

    def encode(self, texts: list[str]):
        """For blocks of texts ``(first, last, ids, counts)``: the ids of the block's
        texts, one after the other, and how many each has."""
        if self.numbers.full:
            self._forget()
        done = []
        for a, b in units.blocks(texts):
            which, counts = self.numbers.of([self.units_of(t) for t in texts[a:b]])
            done.append((a, b, which.astype(np.int32), counts))
        if self.numbers.fresh:
            self._learn()
        for a, b, which, counts in done:
            at, sizes = self.ids.places(which)
            yield a, b, self.ids.flat.all[at], units.sums(sizes, counts)


def decode(ids: list[int], raw: list[bytes]) -> str:
    """The text of a sequence of ids; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")


def _coder(source, specials: bool):
    def run(batches):
        encoder = Encoder(source.value, specials)
        raw = encoder.merges.raw
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in units.blocks(texts, ROUND_CHARS):
                for a, b, ids, counts in encoder.encode(texts[first:last]):
                    ends = np.concatenate(([0], np.cumsum(counts)))
                    flat, cuts = ids.tolist(), ends.tolist()
                    decoded = [decode(flat[i:j], raw) for i, j in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first + a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                         pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
           specials: bool = True) -> DataFrame:
    """One row per document row: ``doc_id, ids, decoded`` (the text that the ids
    stand for). ``tokenizer`` is the path of a byte-level BPE file on the driver."""
    with open(tokenizer, encoding="utf-8") as file:
        source = file.read()
    parse(source)  # an unfit file fails here, not in the tasks
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.mapInArrow(_coder(docs.sparkSession.sparkContext.broadcast(source), specials),
                        f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>, decoded string")
