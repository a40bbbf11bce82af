"""Exact k-nearest-neighbour graph (the first stage of the neighbour
embedding in the studied pipeline), without a cross join.

Pivot (Voronoi) partitioning with triangle-inequality pruning, the exact
kNN-join scheme for MapReduce-style engines (Lu et al., VLDB 2012):

1. pick P pivots in hash order (bounded, broadcast as literals);
2. one pass: per pivot, the k+1 smallest distances from it to any row
   (partial top lists per partition, merged) -> ``u_A``; per cell, the
   largest distance of its rows to its pivot -> ``r_A``. Every row x of cell A
   then has its k-th neighbour within ``theta_A = r_A + u_A``;
3. one pass: each row goes to its own cell as a query, and as a candidate to
   every other cell A with ``d(y, p_A) <= r_A + theta_A`` - any farther row
   cannot be within ``theta_A`` of a row of A;
4. per cell, a numpy kernel finds every query's k nearest candidates and
   emits only those k rows (ties by key).

A large cell (one dense cluster can hold a third of the data) is split into
query chunks x candidate chunks by key hash. A task holds a block's queries
(``QUERY_VALUES`` coordinates) and the k best of each so far while its candidates
pass by in Arrow batches; each block emits its local k best per query, and a
final per-query window keeps the k best of those (the global top k is always
among the block top k lists). Rows are repeated for their blocks by Spark, not
in Python.

Exact by construction. That is the way with a given number of pivots. In few
dimensions (up to ``LOW_DIMENSIONS``) the default is the space tree of
:mod:`tabprep.operators.space`, which keeps nothing that grows on the driver. In many
dimensions bounds prune next to nothing; exact neighbours are then all pairs, and one
cell in bounded query x candidate blocks (no replication by pivots) is the
cheapest exact plan.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.operators import sampling, space

SALTS = 64
LOW_DIMENSIONS = 6
#: Entries of a distance matrix that a task holds at a time.
MATRIX = 4_000_000
#: Entries of it in a block, whose candidates come batch by batch.
BLOCK_MATRIX = 1_000_000
#: Coordinates of a block's queries, which a task holds, and of its candidates, which pass by.
QUERY_VALUES, CANDIDATE_VALUES = 3_200_000, 12_800_000


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def nearest_rows(qvecs: np.ndarray, qkeys: np.ndarray, cvecs: np.ndarray, ckeys: np.ndarray, k: int):
    """``(src, dst, dist)``: each query's ``k`` nearest other candidates (ties by key),
    a bounded matrix at a time."""
    out = [(qkeys[:0], ckeys[:0], np.zeros(0))]
    cnorm = (cvecs * cvecs).sum(1)
    size = max(1, MATRIX // max(len(ckeys), 1))
    for a in range(0, len(qkeys) if len(ckeys) else 0, size):
        qv, qk = qvecs[a: a + size], qkeys[a: a + size]
        d = np.sqrt(np.maximum((qv * qv).sum(1)[:, None] - 2 * qv @ cvecs.T + cnorm[None, :], 0.0))
        d[qk[:, None] == ckeys[None, :]] = np.inf            # not its own neighbour
        # select with the fast expanded form, with a margin, then rank the
        # few survivors by exact distance (ties by key)
        m = min(k, len(ckeys)) - 1
        bound = np.partition(d, m, axis=1)[:, m]
        slack = 1e-6 * (1 + np.sqrt((qv * qv).sum(1) + cnorm.max()))
        bound = np.where(np.isfinite(bound), bound * (1 + 1e-6) + slack, np.finfo(float).max)
        row, col = np.nonzero(d <= bound[:, None])
        exact = np.sqrt(((cvecs[col] - qv[row]) ** 2).sum(1))
        order = np.lexsort((ckeys[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        near = _within(np.bincount(row, minlength=len(qk))) < k
        out.append((qk[row[near]], ckeys[col[near]], exact[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


class _Block:
    """The queries of a block and the ``k`` nearest candidates of each so far, in order."""

    def __init__(self, k: int):
        self.k, self.held, self.queries, self.seen = k, [], None, 0

    def add(self, keys: np.ndarray, v: np.ndarray, query: np.ndarray, cand: np.ndarray) -> None:
        """Rows of the block, its queries first."""
        n = int(query.sum())
        if n:
            self.held.append((keys[:n], v[:n], cand[:n]))
        if n < len(keys):
            self._begin()
            self._meet(keys[n:], v[n:])

    def _begin(self) -> None:
        if self.queries is not None:
            return
        if not self.held:
            self.held.append((np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, bool)))
        keys, v, cand = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.queries = [], (keys, v)
        self.norm = (v * v).sum(1)
        self.dst, self.dist = np.zeros((len(keys), self.k), np.int64), np.full((len(keys), self.k), np.inf)
        own = np.flatnonzero(cand)
        for a in range(0, len(own), BLOCK_MATRIX // 100):
            at = own[a: a + BLOCK_MATRIX // 100]
            self._meet(keys[at], v[at])

    def _meet(self, ckeys: np.ndarray, cvecs: np.ndarray) -> None:
        keys, vecs = self.queries
        cnorm = (cvecs * cvecs).sum(1)
        widest = cnorm.max(initial=0.0, where=np.isfinite(cnorm))
        # |q|^2 - 2 q c + |c|^2 as one product
        right = np.concatenate((-2 * cvecs, np.ones((len(cvecs), 1)), cnorm[:, None]), axis=1).T
        size = max(1, BLOCK_MATRIX // max(len(ckeys), 1))
        for a in range(0, len(keys) if len(ckeys) else 0, size):
            qk, qv, norm = keys[a: a + size], vecs[a: a + size], self.norm[a: a + size]
            d = np.concatenate((qv, norm[:, None], np.ones((len(qv), 1))), axis=1) @ right
            bound = self.dist[a: a + size, -1]
            if self.seen < len(ckeys) and self.k <= len(ckeys):  # too few so far
                near = np.where(qk[:, None] == ckeys[None, :], np.inf, d)
                near = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
                bound = np.minimum(bound, np.sqrt(np.maximum(near, 0.0)))
            # with a margin: the few rows that stay are ranked by their exact distance
            with np.errstate(over="ignore"):
                limit = np.square(bound * (1 + 1e-6) + 1e-6 * (1 + np.sqrt(norm + widest)))
            row, col = np.nonzero(d <= np.where(np.isfinite(limit), limit, np.finfo(float).max)[:, None])
            other = qk[row] != ckeys[col]                        # not its own neighbour
            row, col = row[other], col[other]
            self._keep(a + row, ckeys[col], np.sqrt(((cvecs[col] - qv[row]) ** 2).sum(1)))
        self.seen += len(ckeys)

    def _keep(self, row: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        if not len(row):
            return
        changed, place = np.unique(row, return_inverse=True)
        old = np.isfinite(self.dist[changed])
        row = np.concatenate((np.nonzero(old)[0], place))
        dst, dist = (np.concatenate((held[changed][old], more)) for held, more in ((self.dst, dst), (self.dist, dist)))
        order = np.lexsort((dst, dist, row))
        row, dst, dist = row[order], dst[order], dist[order]
        rank = _within(np.bincount(row, minlength=len(changed)))
        first = rank < self.k
        row, rank = changed[row[first]], rank[first]
        self.dst[row, rank], self.dist[row, rank] = dst[first], dist[first]

    def rows(self):
        self._begin()
        keys, _ = self.queries
        for a in range(0, len(keys), 10_000):
            near = np.isfinite(self.dist[a: a + 10_000])
            src = a + np.nonzero(near)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[src]), pa.array(self.dst[a: a + 10_000][near]), pa.array(self.dist[a: a + 10_000][near])],
                ["src", "dst", "dist"])


def _nearest_groups(k: int):
    """Arrow pass over rows sorted by block, a block's queries first: its candidates pass by."""
    def run(batches):
        at, block = None, None
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in ("cell", "qc", "cc")], axis=1)
            starts = np.flatnonzero(np.append(True, (places[1:] != places[:-1]).any(axis=1))) if len(places) else []
            for a, b in zip(starts, [*starts[1:], len(places)]):
                if at is None or (places[a] != at).any():
                    if block is not None:
                        yield from block.rows()
                    at, block = places[a], _Block(k)
                part = batch.slice(a, b - a)
                block.add(part.column("_key").to_numpy(), _matrix(part.column("_v")),
                          *(part.column(c).to_numpy(zero_copy_only=False) for c in ("query", "cand")))
        if block is not None:
            yield from block.rows()
    return run


def _vectors(df: DataFrame, features: Sequence[str] | str, key: str) -> DataFrame:
    if isinstance(features, str):  # floats are made doubles where they are computed with
        float_ = df.schema[features].dataType == T.ArrayType(T.FloatType(), df.schema[features].dataType.containsNull)
        v = F.col(features) if float_ else F.transform(F.col(features), lambda x: x.cast("double"))
    else:
        v = F.array(*[F.col(c).cast("double") for c in features])
    # a row with a missing coordinate has no distance: not a query, not a neighbour
    return (df.select(F.col(key).alias("_key"), v.alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x))))


def knn_graph(df: DataFrame, features: Sequence[str] | str, k: int = 15,
              key: str = "row_id", n_pivots: int | None = None,
              seed: int = 42, block_rows: int | None = None, report: dict | None = None) -> DataFrame:
    """``src, dst, rank, dist``: the k nearest other rows of every row
    (Euclidean; ties by ``dst``). Blocks have at most ``block_rows`` queries and candidates; by
    default a quarter of a small table, within bounds. ``report`` receives the rows and compared pairs."""
    data = _vectors(df, features, key)
    n = data.count()
    if n <= 1:
        return df.sparkSession.createDataFrame([], "src bigint, dst bigint, rank int, dist double")
    dimensions = len(data.first()["_v"])
    if dimensions <= LOW_DIMENSIONS and n_pivots is None:
        wide = data.withColumn("_v", F.transform("_v", lambda x: x.cast("double")))
        return space.knn_cells(wide, n, dimensions, k, report=report)
    p_count = n_pivots or 1
    quarter = max(256, -(-n // 4))
    query_rows = block_rows or min(max(256, QUERY_VALUES // max(dimensions, 1)), quarter)
    cand_rows = block_rows or min(max(256, CANDIDATE_VALUES // max(dimensions, 1)), quarter)
    pivot_rows = sampling.sample_n(data, p_count, "_key", seed, "pivot").collect()
    pivots = np.array([r["_v"] for r in sorted(pivot_rows, key=lambda r: r["_key"])], dtype=float)
    kk = k + 1

    def dist_to_pivots(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(
            (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)[None, :], 0.0))

    def slices(v: np.ndarray):
        size = max(1, MATRIX // len(pivots))
        return (v[a: a + size] for a in range(0, len(v), size))

    def stats(batches):
        best = None
        rmax = np.zeros(len(pivots))
        for pdf in batches:
            every = np.stack(pdf["_v"].to_numpy()).astype(float)
            for v in slices(every):
                d = dist_to_pivots(v)
                own = d.argmin(1)
                np.maximum.at(rmax, own, d[np.arange(len(own)), own])
                part = np.sort(d, axis=0)[:kk]
                best = part if best is None else np.sort(np.vstack([best, part]), axis=0)[:kk]
        if best is None:
            return
        rows = [(int(a), int(j), float(best[j, a])) for a in range(len(pivots))
                for j in range(best.shape[0])]
        rows += [(int(a), -1, float(rmax[a])) for a in range(len(pivots))]
        yield pd.DataFrame(rows, columns=["pivot", "j", "d"])

    st = data.mapInPandas(stats, "pivot int, j int, d double")
    r_rows = st.where("j = -1").groupBy("pivot").agg(F.max("d").alias("r")).collect()
    radius = np.zeros(len(pivots))
    for row in r_rows:
        radius[row["pivot"]] = row["r"]
    u = np.full(len(pivots), np.inf)
    # the (k+1) smallest distances per pivot, reduced on the executors: the
    # stats hold partitions x (k+1) values per pivot, so they are first cut to
    # k+1 inside salted groups, then merged per pivot; the driver receives
    # pivots x (k+1) values
    def k_smallest(c):
        return F.slice(F.sort_array(F.collect_list(c)), 1, kk)

    cand = (st.where("j >= 0")
            .groupBy("pivot", F.pmod(F.hash("d", "j"), F.lit(SALTS)).alias("_s"))
            .agg(k_smallest("d").alias("ds"))
            .select("pivot", F.explode("ds").alias("d"))
            .groupBy("pivot").agg(k_smallest("d").alias("ds")).collect())
    for row in cand:
        ds = row["ds"]
        if len(ds) >= kk:
            u[row["pivot"]] = ds[kk - 1]
    theta = radius + u
    reach = radius + theta
    reach = reach + 1e-6 * (1.0 + reach)      # margin for rounding of the distances

    def targets(v: np.ndarray):
        d = dist_to_pivots(v)
        own = d.argmin(1)
        hit = d <= reach[None, :]
        hit[np.arange(len(own)), own] = True
        return own, hit

    def cell_sizes(batches):
        q = np.zeros(len(pivots), dtype=np.int64)
        c = np.zeros(len(pivots), dtype=np.int64)
        for pdf in batches:
            for v in slices(np.stack(pdf["_v"].to_numpy()).astype(float)):
                own, hit = targets(v)
                np.add.at(q, own, 1)
                c += hit.sum(0)
        yield pd.DataFrame({"cell": np.arange(len(pivots), dtype=np.int32), "q": q, "c": c})

    sizes = (data.mapInPandas(cell_sizes, "cell int, q long, c long").groupBy("cell")
             .agg(F.sum("q").alias("q"), F.sum("c").alias("c")).collect())
    q_chunks = np.ones(len(pivots), dtype=np.int64)
    c_chunks = np.ones(len(pivots), dtype=np.int64)
    for r in sizes:
        q_chunks[r["cell"]] = max(1, -(-int(r["q"]) // query_rows))
        c_chunks[r["cell"]] = max(1, -(-int(r["c"]) // cand_rows))

    if report is not None:
        report.update(rows=n, pairs=sum(int(r["q"]) * int(r["c"]) for r in sizes))

    def route(batches):
        for batch in batches:
            first = 0
            for v in slices(_matrix(batch.column("_v"))):
                own, hit = targets(v)
                rows, cells = np.nonzero(hit)
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(v)))))
                part = batch.slice(first, len(v))
                first += len(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells.astype(np.int32))),
                     part.column("_key"), part.column("_v")], ["own", "cells", "_key", "_v"])

    routed = data.mapInArrow(route, f"own int, cells array<int>, _key bigint, _v {dict(data.dtypes)['_v']}")
    # a query meets every candidate block of its cell, a candidate every query block (blocks
    # chosen by a hash of the key); the own block's row is a candidate already
    chunks_of = lambda counts: F.get(F.array(*[F.lit(int(c)) for c in counts]), F.col("cell"))
    block = lambda tag, counts: F.pmod(F.xxhash64(F.lit(tag), F.col("_key")), counts).cast("int")
    met = routed.select("own", "_key", "_v", F.explode("cells").alias("cell")).withColumns(
        {"qn": chunks_of(q_chunks), "cn": chunks_of(c_chunks)}).withColumns(
        {"qy": F.when(F.col("cell") == F.col("own"), block("query", F.col("qn"))).otherwise(-1), "cy": block("candidate", F.col("cn"))})
    asks = F.when(F.col("qy") >= 0, F.transform(F.sequence(F.lit(0), F.col("cn") - 1), lambda c: F.struct(
        F.col("qy").alias("qc"), c.alias("cc"), F.lit(True).alias("query"), (c == F.col("cy")).alias("cand")))).otherwise(F.array())
    offers = F.transform(F.filter(F.sequence(F.lit(0), F.col("qn") - 1), lambda q: q != F.col("qy")), lambda q: F.struct(
        q.alias("qc"), F.col("cy").alias("cc"), F.lit(False).alias("query"), F.lit(True).alias("cand")))
    met = met.select("cell", "_key", "_v", F.explode(F.concat(asks, offers)).alias("at")).select("cell", "at.*", "_key", "_v")
    local = (met.repartition("cell", "qc", "cc").sortWithinPartitions("cell", "qc", "cc", F.desc("query"))
             .mapInArrow(_nearest_groups(k), "src bigint, dst bigint, dist double"))
    # merge the block lists: each query has at most k rows per candidate block
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("src", "dst", F.col("rank").cast("int"), "dist"))
