"""SentencePiece encoding and decoding: distinct sampled segmentations by
Gumbel top-k without replacement (perturbed A* over the lattice).

A text's lattice has a node per position and an arc per piece; a segmentation
has the product of its pieces' unigram probabilities, normalised over all
segmentations (the backward sums of the lattice). Every segmentation gets an
independent Gumbel perturbation of its log-probability; the ``k`` with the
largest perturbed values are a sample without replacement. They are found
without enumeration: the maximum over all completions of a prefix is a Gumbel
at the prefix's log-probability, and given that maximum the best completion is
an ordinary random walk along the arcs while the *other* arcs at each step have
a truncated Gumbel of their own. The search keeps an agenda of these
alternatives per text, always opens the one with the largest perturbed value
and stops after ``k`` paths. The largest value left on the agenda is the
threshold kappa; a segmentation's inclusion score is the probability that its
perturbed value exceeds it, ``1 - exp(-exp(log_prob - kappa))`` (1 if the agenda
is empty, that is if the text has no further segmentation).

Random numbers are a hash of the row key, the round, the position and the step,
so a row's samples do not depend on its batch, partition or executor.

Lattices are made once per distinct word (see :func:`words_of`) and kept for the task's next
blocks of texts (up to ``MAX_ARCS`` arcs), all steps are array operations over a
block, and there is no shuffle. Decoding joins
the pieces' bytes and gives the text back exactly.

Defined results: a null or empty text has one segmentation, the empty one, with
log-probability 0 and inclusion 1; a text with fewer than ``k`` segmentations
gives them all; equal texts under equal keys have equal samples, and repeated
rows stay repeated; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm import pieces as pc
from tabprep.llm import units
from tabprep.llm.common import released

SAMPLES = 3
SEED = 17
#: Exponent of the piece probabilities (1: the model's own distribution).
ALPHA = 0.3
#: Characters of text (or one text) whose words, lattices and paths are in memory at a time.
BLOCK_CHARS = 200_000
#: Arcs of lattices that a task keeps (24 bytes each); more are dropped and made anew when needed.
MAX_ARCS = 1_000_000
#: Arcs that there is room for from the start (memory is taken as it is filled); more make the arrays grow.
ROOM = MAX_ARCS + 500_000
#: Words whose lattices are made at a time.
ADDED = 10_000
#: Characters of words (or one word more) whose arcs are found at a time.
SLICE_CHARS = 25_000
#: Alternatives from which a path's cut-off is estimated.
FIRST = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from a seed and further integers."""
    x = seed
    for p in parts:
        step = (np.atleast_1d(p).astype(np.uint64) + np.uint64(1)) * _BASE
        x = _mix(x + step)
    out = (x >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out /= float(1 << 53)
    return out


def string_hashes(strings: list[str]) -> np.ndarray:
    out = np.zeros(len(strings), np.uint64)
    for i, s in enumerate(strings):
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


class Vocabulary:
    """Pieces by the leading bits of their hashes; those whose bits another piece has are searched."""

    def __init__(self, pieces: pc.Pieces):
        self.pieces = pieces
        texts = list(pieces.ids)
        self.hashes = string_hashes(texts)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ids = np.fromiter((pieces.ids[t] for t in texts), np.int32, len(texts))
        self.scores = np.fromiter((pieces.scores[t] for t in texts), np.float64, len(texts))
        self.slots = np.full(1 << 20, -1, np.int32)
        own = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.slots[own] = np.arange(len(texts))                     # the last of a slot's pieces
        hidden = np.flatnonzero(self.slots[own] != np.arange(len(texts)))
        self.hidden = hidden[np.argsort(self.hashes[hidden])]

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of length ``n``, and the pieces' places."""
        at = self.slots[h >> np.uint64(44)]
        maybe = np.flatnonzero(at >= 0)
        at, own = at[maybe], h[maybe]
        ok = self.hashes[at] == own
        if len(self.hidden):
            other = np.flatnonzero(~ok)
            place = np.minimum(np.searchsorted(self.hashes[self.hidden], own[other]), len(self.hidden) - 1)
            at[other] = self.hidden[place]
            ok[other] = self.hashes[at[other]] == own[other]
        ok &= self.length[at] == n
        return maybe[ok], at[ok]


class Lattices:
    """The lattices of many words: nodes are numbered through, a word of ``n``
    characters (its separator included) has ``n + 1``; arcs are grouped by source node, the longest first.
    Words are worked on together, as arrays of characters x piece lengths; the
    backward sums take those of equal length at a time."""

    def __init__(self, vocab: Vocabulary, alpha: float = ALPHA):
        self.vocab, self.alpha, self.numbers = vocab, alpha, units.Numbers()
        self.mass = np.exp(alpha * vocab.scores)
        self.held = {name: units.Grown(kind, room=room) for name, kind, room in (
            ("first", np.int64, 0), ("last", np.int64, 0), ("ptr", np.int64, MAX_ARCS), ("end", np.int32, ROOM),
            ("piece", np.int32, ROOM), ("logp", np.float64, ROOM), ("cdf", np.float32, ROOM), ("rest", np.float32, ROOM))}
        self._grow(ptr=np.zeros(1, np.int64))

    def forget(self):
        """Drop all words and lattices; the arrays are used again."""
        self.numbers = units.Numbers()
        for held in self.held.values():
            held.n = 0
        self._grow(ptr=np.zeros(1, np.int64))

    def _grow(self, **more):
        for name, values in more.items():
            self.held[name].add(values)
        for name, held in self.held.items():
            setattr(self, name, held.all)

    def learn(self):
        """Make the lattices of the words that were numbered and have none."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for a in range(0, len(fresh), ADDED):
            self._add([w if w[:1] == "\n" else pc.SPACE + w for w in fresh[a: a + ADDED]])

    def _add(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        by_size = np.argsort(size, kind="stable")
        chars = np.frombuffer("".join([words[i] for i in by_size]).encode("utf-32-le", "surrogatepass"),
                              np.uint32)
        first = np.zeros(len(words), np.int64)
        src, dst, piece, own, at, nodes = [], [], [], [], 0, 0
        cuts = np.flatnonzero(np.diff(np.cumsum(size[by_size]) // SLICE_CHARS)) + 1  # bounds the arrays of a slice
        for mine in np.split(by_size, cuts):
            n = size[mine]
            first[mine] = nodes + np.cumsum(n + 1) - (n + 1)
            to = at + int(n.sum())
            for whole, x in zip((src, dst, piece, own), self._slice(chars[at:to], n, nodes)):
                whole.append(x)
            at, nodes = to, nodes + to - at + len(mine)
        start, end, piece, own = (np.concatenate(x) for x in (src, dst, piece, own))
        ptr = np.cumsum(np.bincount(start, minlength=nodes))
        total = np.cumsum(own)
        cdf = (total - np.concatenate(([0.0], total))[np.concatenate(([0], ptr))[start]]).astype(np.float32)
        cdf[ptr[np.diff(ptr, prepend=0) > 0] - 1] = np.inf  # rounding never runs past a node's arcs
        base = len(self.ptr) - 1
        with np.errstate(divide="ignore"):
            rest = np.where(own > 1 - 1e-12, -np.inf, np.log1p(-np.minimum(own, 1.0)))  # all other arcs of the node
        self._grow(first=base + first, last=base + first + size, ptr=ptr + len(self.end), end=end + base, piece=piece,
                   logp=np.log(own), cdf=cdf, rest=rest)

    def _slice(self, chars: np.ndarray, size: np.ndarray, node: int):
        """Arcs ``(source, target, piece, probability given the source)`` of words, the shortest first."""
        longest = min(int(size[-1]), self.vocab.pieces.longest)
        mass = np.zeros((len(chars), longest))
        ids = np.zeros((len(chars), longest), np.int32)
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(chars))        # characters up to the word's end
        code = chars.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        h, at = np.zeros(len(chars), np.uint64), np.arange(len(chars))
        for k in range(1, longest + 1):
            if k > 1:
                on = left[at] >= k
                h, at = h[on], at[on]
            h = h * _BASE + code[at + (k - 1)]
            hit, which = self.vocab.find(k, h)
            cell = at[hit] * longest + (longest - k)
            mass.reshape(-1)[cell] = self.mass[which]
            ids.reshape(-1)[cell] = self.vocab.ids[which]
        lone = np.flatnonzero(mass[:, longest - 1] == 0)            # characters without a piece: their bytes
        point = chars[lone].astype(np.int64)
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        mass[lone, longest - 1] = np.exp(self.alpha * pc.BYTE_SCORE * width)
        ids[lone, longest - 1] = np.where(width == 1, np.array(self.vocab.pieces.byte_ids)[np.minimum(point, 127)],
                                          -point)
        done = 0
        for n, w in zip(*(x.tolist() for x in np.unique(size, return_counts=True))):
            self._backward(mass[done: done + w * n].reshape(w, n, longest))
            done += w * n
        at = np.flatnonzero(mass)
        cell = at // longest
        nodes = node + np.arange(len(chars)) + np.repeat(np.arange(len(size)), size)  # a word has one more than characters
        start = nodes[cell]
        return start, start + longest - (at - cell * longest), ids.reshape(-1)[at].astype(np.int64), mass.reshape(-1)[at]

    @staticmethod
    def _backward(mass: np.ndarray):
        """Turn the masses of words of one length into probabilities given the source, by backward sums."""
        w, n, longest = mass.shape
        beta = np.ones((w, n + 1))
        for i in range(n - 1, -1, -1):
            m = min(longest, n - i)
            cand = mass[:, i, longest - m:]
            cand *= beta[:, i + 1: i + m + 1][:, ::-1]
            beta[:, i] = total = cand.sum(axis=1)
            cand /= total[:, None]
            if i % 4 == 0:                                          # only ratios within a piece's reach matter
                beta[:, i: i + longest + 1] /= beta[:, i: i + 1].copy()

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc of each node for a uniform number."""
        arc = self.ptr[node]
        more = np.flatnonzero(u > self.cdf[arc])
        while len(more):
            arc[more] += 1
            more = more[u[more] > self.cdf[arc[more]]]
        return arc


def _walk(lat: Lattices, node: np.ndarray, last: np.ndarray, seed: np.ndarray, rnd: int):
    """Random walks from nodes to their words' ends: ``(walk, arc)`` in order."""
    walks, arcs, live, step = [], [], np.flatnonzero(node < last), 0
    while len(live):
        arc = lat.choose(node[live], uniform(seed[live], rnd * 1_000_003 + step))
        walks.append(live)
        arcs.append(arc)
        node[live] = on = lat.end[arc]
        live = live[on < last[live]]
        step += 1
    if not walks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    walks, arcs = np.concatenate(walks), np.concatenate(arcs)
    order = np.argsort(walks, kind="stable")
    return walks[order], arcs[order]


def _truncated(phi: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel at ``phi`` given that it is at most ``top`` (minus infinity for no mass)."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        g = phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(g, top))


class _Path:
    """An emitted segmentation of a text: its arcs, the word of each, the
    log-probabilities before each, and the perturbed values of the alternatives."""

    def __init__(self, arcs, words, before, g):
        self.arcs, self.words, self.before, self.g = arcs, words, before, g
        self.split, self.excluded = -1, []

    def graft(self, parent: _Path, t: int, arc: int, first: float):
        """Put the parent's first ``t`` arcs and the arc of the split before the own ones."""
        self.arcs = np.concatenate((parent.arcs[:t], [arc], self.arcs))
        self.words = np.concatenate((parent.words[: t + 1], self.words))
        self.before = np.concatenate((parent.before[: t + 1], [first], self.before[1:]))

    @property
    def phi(self) -> float:
        return float(self.before[-1])

    def agenda(self, others: np.ndarray):
        self.others = others
        self._top()

    def close(self, t: int):
        self.others[t] = -np.inf
        self._top()

    def _top(self):
        self.at = int(self.others.argmax()) if len(self.others) else -1
        self.best = float(self.others[self.at]) if len(self.others) else -np.inf


def words_of(texts: list[str], lat: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the lattice of each word. A word is a
    separator - the marker of a space (also before the text) or a line end - and
    what follows up to the next one. No piece has an inner separator, so a text's
    segmentations are those of its words, one after the other."""
    cut = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]  # a word of a line begins with its line end
    which, counts = lat.numbers.of(cut)
    lat.learn()
    return counts, which


def contenders(before: np.ndarray, rest: np.ndarray, top: float, k: int) -> int:
    """How many of a path's first alternatives can be among its ``k + 1`` largest
    perturbed values. With 53-bit uniforms a perturbed value lies between 3.7
    below and 37.5 above its log-mass (or at most 3.7 below the bound ``top``), and
    the log-masses fall along the path, so later ones cannot win."""
    phi = before[: len(rest)] + rest
    phi = phi[phi > -np.inf]
    if len(phi) <= k:
        return len(before)
    floor = min(float(np.partition(phi, len(phi) - k - 1)[len(phi) - k - 1]), top) - 42.0
    return int(np.searchsorted(-before, -floor, side="right"))


def sample_block(texts: list[str], seeds: np.ndarray, k: int, lat: Lattices):
    """Per text a list of ``(piece numbers, log_prob, perturbed, inclusion)``;
    a piece number below zero is a character to be written as bytes."""
    counts, which = words_of(texts, lat)
    begins = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(which)) - begins[doc]
    seeds = seeds.astype(np.uint64)
    own_seed = _mix(seeds[doc] + (place.astype(np.uint64) + np.uint64(1)) * _BASE)
    first, last = lat.first[which], lat.last[which]
    g_root = -np.log(-np.log(uniform(seeds, 999_999_937)))
    paths: list[list[_Path]] = [[] for _ in texts]
    for rnd in range(k):
        if rnd == 0:
            at, heads = np.arange(len(which)), {}
            start = first.copy()
        else:  # open the best alternative of each text's agenda
            heads = {}
            for i, mine in enumerate(paths):
                parent = max(mine, key=lambda p: p.best, default=None)
                if parent is not None and parent.best > -np.inf:
                    heads[i] = (parent, parent.at, parent.best)
            if not heads:
                break
            some, at = np.fromiter(heads, np.int64), np.array([h[1] for h in heads.values()])
            nodes = np.searchsorted(lat.ptr, [p.arcs[t] for p, t, _ in heads.values()], side="right") - 1
            choice = uniform(seeds[some], rnd * 1_000_003 + 500_000, at)
            left, before = np.zeros(len(some)), np.zeros(len(some))
            for j, (i, (parent, t, top)) in enumerate(heads.items()):
                gone = [int(parent.arcs[t]), *(parent.excluded if t == parent.split else [])]
                free = [a for a in range(lat.ptr[nodes[j]], lat.ptr[nodes[j] + 1]) if a not in gone]
                mass = np.exp(lat.logp[free])
                p = mass.cumsum()
                n = min(int(p.searchsorted(choice[j] * p[-1])), len(free) - 1)
                heads[i] = (parent, t, free[n], [*gone, free[n]], top)
                if len(free) > 1:                    # what the node's further arcs have, for this path's agenda
                    left[j], before[j] = 1.0 - math.fsum(np.exp(lat.logp[[*gone, free[n]]])), parent.before[t]
                parent.close(t)
            with np.errstate(divide="ignore", invalid="ignore"):
                phi = np.where(left > 1e-12, before + np.log(left), -np.inf)
            further = dict(zip(heads, _truncated(phi, np.array([h[4] for h in heads.values()]),
                                                 uniform(seeds[some], rnd * 1_000_003 + 900_000, at))))
            words = [begins[i] + h[0].words[h[1]] for i, h in heads.items()]
            at = np.concatenate([np.arange(w, begins[i] + counts[i]) for w, i in zip(words, heads)])
            start = first[at]
            lengths = np.array([begins[i] + counts[i] - w for w, i in zip(words, heads)])
            start[np.cumsum(lengths) - lengths] = lat.end[[h[2] for h in heads.values()]]
        walk, arcs = _walk(lat, start, last[at], own_seed[at], rnd)
        occ = at[walk]
        owner, words = doc[occ], place[occ]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        lp = lat.logp[arcs]
        tops, near = g_root.copy(), np.zeros(len(texts), np.int64)
        lead = np.zeros(len(arcs))
        for i in (heads or np.flatnonzero(counts)):
            a, b = bounds[i], bounds[i + 1]
            base = 0.0
            if heads:
                parent, t, arc, held, tops[i] = heads[i]
                base = float(parent.before[t] + lat.logp[arc])
            before = np.full(b - a + 1, base)
            before[1:] += np.cumsum(lp[a:b])
            path = _Path(arcs[a:b], words[a:b], before, tops[i])
            lead[a:b] = before[:-1]
            near[i] = contenders(before[:-1], lat.rest[arcs[a: min(b, a + FIRST)]], tops[i], k)
            if heads:
                path.graft(parent, t, arc, base)
                path.split, path.excluded = t, held[:-1]
            paths[i].append(path)
        # only these alternatives can still be opened or be the threshold
        ends = np.cumsum(near)
        who = np.repeat(np.arange(len(texts)), near)
        index = np.arange(len(who)) - (ends - near)[who]
        flat = bounds[who] + index
        others = _truncated(lead[flat] + lat.rest[arcs[flat]], tops[who],
                            uniform(seeds[who], rnd * 1_000_003 + 700_000, index))
        for i in (heads or np.flatnonzero(counts)):
            path, head = paths[i][-1], np.zeros(0)
            if heads:
                head = np.full(heads[i][1] + 1, -np.inf)  # the alternatives before the split belong to the parent
                head[-1] = further[i]
            path.agenda(np.concatenate((head, others[ends[i] - near[i]: ends[i]])))
    out = []
    for i, mine in enumerate(paths):
        kappa = max((p.best for p in mine), default=-np.inf)
        found = [(lat.piece[p.arcs], p.phi, p.g, 1.0 if kappa == -np.inf else
                  float(-np.expm1(-np.exp(min(p.phi - kappa, 50.0))))) for p in mine]
        out.append(found if counts[i] else [(np.zeros(0, np.int64), 0.0, float(g_root[i]), 1.0)])
    return out


def to_ids(numbers: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Piece numbers with the characters below zero written as byte pieces."""
    if not len(numbers) or numbers.min() >= 0:
        return numbers
    out: list[int] = []
    for n in numbers.tolist():
        out.extend([n] if n >= 0 else [vocab.pieces.byte_ids[b] for b in chr(-n).encode("utf-8", "replace")])
    return np.array(out, np.int64)


def _sampler(pieces, k: int, alpha: float):
    def run(batches):
        vocab = Vocabulary(pieces.value)
        lat = Lattices(vocab, alpha)
        raw = pa.array(vocab.pieces.raw, pa.large_binary())
        for batch in batches:
            sizes = compute.utf8_length(batch.column(0)).to_pylist()
            for first, last in units.cuts(sizes, BLOCK_CHARS):
                rows = batch.slice(first, last - first)         # only a block's texts are held as Python's
                texts = rows.column(0).to_pylist()
                seeds = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                if len(lat.end) > MAX_ARCS:
                    lat.forget()
                yield batch_of(rows.column(2), texts, sample_block(texts, seeds, k, lat), vocab, raw)
    return run


def batch_of(doc_ids, texts: list[str], found: list, vocab: Vocabulary, raw: pa.Array) -> pa.RecordBatch:
    """The samples of the texts as rows."""
    rows = [(i, r, to_ids(s[0], vocab), *s[1:]) for i, f in enumerate(found) for r, s in enumerate(f, 1)]
    ends = np.cumsum([0, *(len(x[2]) for x in rows)])
    flat = pa.array(np.concatenate([x[2] for x in rows]).astype(np.int32))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    joined = raw.take(flat)                                         # the bytes of all rows, one after the other
    at = np.frombuffer(joined.buffers()[1], np.int64)[ends].tolist()
    data = joined.buffers()[2].to_pybytes() if at[-1] else b""
    given = [t.encode("utf-8", "replace") for t in texts]
    same = [data[a + 1: b] == given[x[0]] for x, a, b in zip(rows, at, at[1:])]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array([x[0] for x in rows], pa.int64())), pa.array([x[1] for x in rows], pa.int32()), ids,
         *(pa.array([x[j] for x in rows], pa.float64()) for j in (3, 4, 5)), pa.array(same, pa.bool_())],
        ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = SEED,
           alpha: float = ALPHA, model: str = pc.MODEL) -> DataFrame:
    """Up to ``k`` rows per document row: ``doc_id, rank, ids, log_prob,
    perturbed, inclusion, round_trip`` (the ids decode to the text)."""
    pieces = docs.sparkSession.sparkContext.broadcast(pc.load(model))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    d = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), key).alias("seed"),
                    F.col(doc_id).alias("doc_id"))
    return d.mapInArrow(released(_sampler(pieces, k, alpha)), f"doc_id {dict(d.dtypes)['doc_id']}, rank int, ids array<int>, "
                                                       "log_prob double, perturbed double, inclusion double, round_trip boolean")
