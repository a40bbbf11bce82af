"""Hard-negative mining with rotated one-bit codes.

Vectors are turned to integers, ``floor(256 x)``, and scored by integer inner
products. Every row gets codes: its vector is rotated by a fixed random
orthogonal matrix, and each of ``LEVELS`` levels stores the signs of what the
level before left over, as bits, with the alignment of that rest with its sign
vector (``a = <r, s> / d``); the next rest is ``r - a s``, which is orthogonal to
``s``. The norm of the last rest is stored too.

An anchor's rotated vector is rounded to ``PLANES`` bits a component, as bit planes, so
that the product of a sign code with it is popcounts of ANDed words. The sum of
alignment times product over the levels is the estimate of a row's score. What
it misses is the last rest ``r``: since ``r`` is orthogonal to its sign vector, Cauchy
and Schwarz bound ``|<r, q>|`` by ``|r|`` times the norm of the part of ``q`` orthogonal
to ``s``; and the rounding of ``q``, bounded by the row's norm times the rounding
error's. Both are certain, so a row whose interval cannot reach a place wanted is
rightly left out; the surviving rows are scored by integer products and decide.

Anchors and rows are dealt to blocks by their number, every pair of blocks is one group
of a grouped job (anchors against all rows, in blocks of bounded size, whatever
labels the rows have). The first job keeps each anchor's best rows of its label, the
second the best rows of other labels in each positive's window; blocks send a few
rows per anchor, which are ranked over all blocks. Thresholds tighten while a block is
worked through, so few intervals survive.

Defined results: rows with a null label, null vector, null or non-finite component,
null id, or a component of ``2**19`` or more (its products leave 64 bits) take no part.
Shorter vectors count as filled up with zeros. Repeated ids are one row: the one with the
smallest label, then the smallest vector. Ties are broken by the smaller id. Anchors
without positives or positives without negatives give no rows; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.session import materialize

LEVELS, PLANES, SEED = 4, 6, 12
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows and anchors of a block at most (as a mean), and rows and anchors estimated at a time.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 4096
SLICE_ROWS, SLICE_ANCHORS = 2048, 256
LIMIT = float(1 << 19)
_NONE = np.iinfo(np.int64).min


def integers(docs: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """The rows that take part: ``id, label, v`` (integers), one per id."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    rows = docs.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c * 256).cast("int")).alias("v")).filter("label is not null")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def matrix(vectors, d: int) -> np.ndarray:
    """A list column as integers, filled up with zeros to ``d`` columns."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), d), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Codes:
    """Rows' codes: sign bits and alignments by level, norm of the last rest, norm."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, levels: int = LEVELS):
        d = len(turn)
        rest = v @ turn
        self.norm = np.sqrt((rest * rest).sum(axis=1))
        self.bits, self.align = [], []
        for _ in range(levels):
            up = rest >= 0
            sign = np.where(up, 1.0, -1.0)
            a = (rest * sign).sum(axis=1) / d
            rest = rest - a[:, None] * sign
            self.bits.append(pack(up))
            self.align.append(a)
        self.rest = np.sqrt((rest * rest).sum(axis=1))

    def part(self, rows) -> Codes:
        out = object.__new__(Codes)
        out.norm, out.rest = self.norm[rows], self.rest[rows]
        out.bits, out.align = [b[rows] for b in self.bits], [a[rows] for a in self.align]
        return out


class Asked:
    """Anchors' rotated vectors in bit planes: ``low + step * number`` is near each component."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        q = v @ turn
        self.d = len(turn)
        self.low = q.min(axis=1)
        step = (q.max(axis=1) - self.low) / ((1 << planes) - 1)
        self.step = np.where(step > 0, step, 1.0)
        number = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * number
        self.norm = np.sqrt((near * near).sum(axis=1))
        self.error = np.sqrt(((q - near) ** 2).sum(axis=1))
        self.planes = [pack((number >> j) & 1 > 0) for j in range(planes)]
        self.total = number.sum(axis=1)

    def part(self, rows) -> Asked:
        out = object.__new__(Asked)
        out.d = self.d
        for name in ("low", "step", "norm", "error", "total"):
            setattr(out, name, getattr(self, name)[rows])
        out.planes = [p[rows] for p in self.planes]
        return out


def popcounts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common bits of every row of ``x`` with every row of ``y``."""
    out = np.bitwise_count(x[:, None, 0] & y[None, :, 0]).astype(np.int32)
    for w in range(1, x.shape[1]):
        out += np.bitwise_count(x[:, None, w] & y[None, :, w])
    return out


def intervals(asked: Asked, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Certain bounds of every anchor's scores with every row."""
    estimate = np.zeros((len(asked.low), len(codes.norm)))
    for bits, align in zip(codes.bits, codes.align):
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        both = np.zeros(estimate.shape, np.int32)
        for j, plane in enumerate(asked.planes):
            both += popcounts(plane, bits) << j
        product = asked.step[:, None] * (2 * both - asked.total[:, None]) + asked.low[:, None] * (2 * ones - asked.d)[None, :]
        estimate += align[None, :] * product
    beside = np.sqrt(np.maximum(asked.norm[:, None] ** 2 - product * product / asked.d, 0.0))
    half = codes.rest[None, :] * beside + codes.norm[None, :] * asked.error[:, None]
    half += 1e-9 * codes.norm[None, :] * (asked.norm + asked.error)[:, None] + 1e-6  # rounding of the floats themselves
    return estimate - half, estimate + half


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``x`` with those of ``y``."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2 ** 53:
        return np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ij->i", x, y)


class Best:
    """The ``k`` best rows (score, then the smaller id) of each of ``n`` places."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.zeros((n, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray):
        if not len(place):
            return
        k = self.score.shape[1]
        touched, own = np.unique(place, return_inverse=True)
        held = self.score[touched] != _NONE
        all_place = np.concatenate((own, np.repeat(np.arange(len(touched)), k)[held.ravel()]))
        all_score = np.concatenate((score, self.score[touched][held]))
        all_id = np.concatenate((ids, self.id[touched][held]))
        order = np.lexsort((all_id, -all_score, all_place))
        p = all_place[order]
        first = np.searchsorted(p, np.arange(len(touched)))
        rank = np.arange(len(p)) - first[p]
        on = rank < k
        new_score, new_id = np.full((len(touched), k), _NONE), np.zeros((len(touched), k), np.int64)
        new_score[p[on], rank[on]], new_id[p[on], rank[on]] = all_score[order][on], all_id[order][on]
        self.score[touched], self.id[touched] = new_score, new_id

    def rows(self):
        at, rank = np.nonzero(self.score != _NONE)
        return at, self.id[at, rank], self.score[at, rank]


def nearest_of_label(anchors, rows, turn, k: int = POSITIVES):
    """Per anchor (``id, label, v``) its best other rows of the same label:
    ``(place of the anchor, id, score)``."""
    ids, labels, v = anchors
    row_ids, row_labels, w = rows
    best = Best(len(ids), k)
    for label in np.intersect1d(labels, row_labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
        asked, codes = Asked(v[mine], turn), Codes(w[theirs], turn)
        for r in range(0, len(theirs), SLICE_ROWS):
            some = theirs[r: r + SLICE_ROWS]
            part = codes.part(slice(r, r + SLICE_ROWS))
            for a in range(0, len(mine), SLICE_ANCHORS):
                own = mine[a: a + SLICE_ANCHORS]
                low, high = intervals(asked.part(slice(a, a + SLICE_ANCHORS)), part)
                other = ids[own][:, None] != row_ids[some][None, :]
                low[~other] = -np.inf
                sure = np.partition(low, -k, axis=1)[:, -k] if len(some) >= k else np.full(len(own), -np.inf)
                least = np.maximum(sure, best.last[own])     # k scores are at least this
                i, j = np.nonzero(other & (high >= least[:, None]))
                best.offer(own[i], products(v[own[i]], w[some[j]]), row_ids[some[j]])
    return best.rows()


def in_window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest integer score in the window of a positive's score."""
    return -((-LEAST * positive) // 100), (MOST * positive) // 100


def best_in_windows(anchors, positives, rows, turn, k: int = NEGATIVES):
    """Per positive (``place of its anchor, score``) the best rows of other labels in its
    window: ``(place of the positive, id, score)``."""
    ids, labels, v = anchors
    owner, score = positives
    row_ids, row_labels, w = rows
    best = Best(len(owner), k)
    low_end, high_end = in_window(score)
    asked, codes = Asked(v, turn), Codes(w, turn)
    for r in range(0, len(row_ids), SLICE_ROWS):
        some = slice(r, r + SLICE_ROWS)
        part = codes.part(some)
        for a in range(0, len(ids), SLICE_ANCHORS):
            own = np.arange(a, min(a + SLICE_ANCHORS, len(ids)))
            mine = np.flatnonzero((owner >= a) & (owner < a + SLICE_ANCHORS))
            if not len(mine):
                continue
            low, high = intervals(asked.part(slice(a, a + SLICE_ANCHORS)), part)
            other = labels[own][:, None] != row_labels[some][None, :]
            # what can enter a window: at least its low end and its k-th best so far, at most its high end
            least, most = np.full(len(own), np.inf), np.full(len(own), -np.inf)
            np.minimum.at(least, owner[mine] - a, np.maximum(low_end[mine], best.last[mine]))
            np.maximum.at(most, owner[mine] - a, high_end[mine])
            i, j = np.nonzero(other & (high >= least[:, None]) & (low <= most[:, None]))
            exact = products(v[own[i]], w[some][j])
            # each surviving pair with the windows of its anchor
            order = mine[np.argsort(owner[mine], kind="stable")]
            first = np.searchsorted(owner[order], own)
            count = np.searchsorted(owner[order], own, side="right") - first
            pair = np.repeat(np.arange(len(i)), count[i])
            place = order[np.arange(len(pair)) - np.repeat(np.cumsum(count[i]) - count[i], count[i]) + np.repeat(first[i], count[i])]
            fits = (exact[pair] >= low_end[place]) & (exact[pair] <= high_end[place]) & (exact[pair] >= best.last[place])
            best.offer(place[fits], exact[pair][fits], row_ids[some][j][pair[fits]])
    return best.rows()


def _dealt(df: DataFrame, side: str, blocks: int, others: int) -> DataFrame:
    """Every row of one side in its own block, against each block of the other."""
    own = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    pair = (own, other) if side == "anchor" else (other, own)
    return df.select("*", pair[0].cast("int").alias("anchor_block") if side == "anchor" else pair[0].alias("anchor_block"),
                     pair[1].alias("row_block") if side == "anchor" else pair[1].cast("int").alias("row_block"))


def _sides(left: pa.Table, right: pa.Table, d: int):
    get = lambda t: (t["id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], d))
    return get(left), get(right)


def _best_rows(df: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group of ``keys`` (score, then the smaller id), ranked from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), ident)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         anchor: Column | None = None, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """One row per anchor, positive and negative: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``. ``anchor`` tells from the id
    column ``id`` which rows are anchors (default: divisible by 50)."""
    label = F.col(label) if isinstance(label, str) else label
    is_anchor = (F.col("id") % 50 == 0) if anchor is None else anchor
    rows = materialize(integers(vectors, vec_id, vector, label).withColumn("is_anchor", is_anchor), "integers")
    n, asked, longest = rows.agg(F.count("*"), F.sum(F.col("is_anchor").cast("long")), F.max(F.size("v"))).first()
    d = max(64, -(-(longest or 0) // 64) * 64)
    turn = rotation(d)
    nr, na = max(1, math.ceil(n / block_rows)), max(1, math.ceil((asked or 0) / block_anchors))
    keys = ["anchor_block", "row_block"]
    anchors = rows.filter("is_anchor").drop("is_anchor")
    against = _dealt(rows.drop("is_anchor"), "row", nr, na).groupBy(*keys)

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = _sides(left, right, d)
        at, ids, score = nearest_of_label(a, r, turn)
        return pa.table({"id": a[0][at], "positive_id": ids, "positive_score": score})

    found = _dealt(anchors, "anchor", na, nr).groupBy(*keys).cogroup(against).applyInArrow(
        positives, "id long, positive_id long, positive_score long")
    found = _best_rows(found, ["id"], "positive_score", "positive_id", POSITIVES).drop("rank")
    asked_for = materialize(anchors.join(found.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p")), "id"), "positives")

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r = _sides(left, right, d)
        lists = left["p"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        owner = np.repeat(np.arange(len(a[0])), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        p_id = flat.field("positive_id").to_numpy(zero_copy_only=False)
        p_score = flat.field("positive_score").to_numpy(zero_copy_only=False)
        at, ids, score = best_in_windows(a, (owner, p_score), r, turn)
        return pa.table({"anchor_id": a[0][owner[at]], "positive_id": p_id[at], "positive_score": p_score[at],
                         "negative_id": ids, "negative_score": score})

    out = _dealt(asked_for, "anchor", na, nr).groupBy(*keys).cogroup(against).applyInArrow(
        negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _best_rows(out, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
