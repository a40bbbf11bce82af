"""R7 in few dimensions: exact nearest neighbours by a tree of space cells.

1. *Cells.* Rows start in one cell. In rounds, every cell with more than
   :func:`cell_size` rows is cut along its widest side at approximate quantiles (16 parts at most; halves,
   where most values are equal), all cells of a round by grouped aggregates and a join on
   the cell. The cells' bounding boxes are tables, one per round; the work and the
   number of cells are proportional to the rows, and none of them is collected.
2. *Inside.* Each cell gives its rows their nearest within it. The k-th distance is the
   radius within which better ones may be elsewhere. A row of a cell with too few rows has the
   largest distance to the box of the nearest cell above that has enough.
3. *Across the borders.* Rows go down the tree from the root, a join per round, into
   every child whose box is within their radius; the cells they reach, other than their
   own, meet them in one group and add what is nearer.
4. *Best.* The lists of a row are merged.

Cells of equal points can be large; they, and the rows that ask in a cell, are split into
chunks by key, every chunk of the asking meeting every chunk of the asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.operators.joins import sized_broadcast
from tabprep.session import materialize

PARTS, CHUNK_ROWS = 16, 20_000


def _sides(d: int) -> list[Column]:
    return [F.array(*[f(F.get("_v", F.lit(i))) for i in range(d)]) for f in (F.min, F.max)]


def cell_size(n: int) -> int:
    """Rows that a cell holds at most: few for a small table, so that bounds prune."""
    return min(1024, max(128, n // 64))


def space_tree(rows: DataFrame, d: int, cell_rows: int) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """The rows with their final ``cell``, and for every round the cells made in it with
    their number: ``parent, cell, n, lo, hi, leaf``. A cell's id is its parent's times 16 plus a number."""
    rows = rows.withColumn("cell", F.lit(1).cast("long"))
    done, rounds, live = None, [], rows
    while True:
        low, high = _sides(d)
        cells = live.groupBy("cell").agg(F.count("*").alias("n"), low.alias("lo"), high.alias("hi"))
        width = F.zip_with("hi", "lo", lambda a, b: a - b)
        leaf = (F.col("n") <= cell_rows) | (F.array_max("width") <= 0)
        cells = cells.withColumn("width", width).select(
            F.expr(f"cell div {PARTS}").alias("parent"), "cell", "n", "lo", "hi", leaf.alias("leaf"),
            (F.array_position("width", F.array_max("width")) - 1).cast("int").alias("dim"))
        cells = materialize(cells, "cells")
        count = cells.count()
        rounds.append((cells.drop("dim"), count))
        open_cells = cells.filter("not leaf").select("cell", "n", "dim", F.get("lo", F.col("dim")).alias("a"), F.get("hi", F.col("dim")).alias("b"))
        split = open_cells.count()
        if not split:
            done = live if done is None else done.unionByName(live)
            return materialize(done, "in-cells"), rounds
        inside = live.join(sized_broadcast(open_cells, split), "cell")
        ranks = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
        # as many of the parts' borders as the cell needs
        wanted = F.least(F.lit(PARTS), F.greatest(F.lit(2), F.ceil(F.col("n") / cell_rows))).cast("int")
        cuts = inside.groupBy("cell", "n", "dim", "a", "b").agg(
            F.percentile_approx(F.get("_v", F.col("dim")), ranks, 1000).alias("q"))
        cuts = cuts.withColumn("q", F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.get(
            F.col("q"), F.floor(i * PARTS / wanted).cast("int") - 1)))
        cuts = cuts.withColumn("q", F.array_distinct(F.filter("q", lambda c: (c < F.col("b")) & (c >= F.col("a")))))
        middle = F.col("a") / 2 + F.col("b") / 2
        half = F.when((middle >= F.col("a")) & (middle < F.col("b")), middle).otherwise(F.col("a"))
        cuts = materialize(cuts.select("cell", "dim", F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(half)).alias("q")), "cuts")
        part = F.size(F.filter("q", lambda c: c < F.get("_v", F.col("dim"))))
        rest = live.join(sized_broadcast(cells.filter("leaf").select("cell"), count), "cell", "left_semi")
        done = rest if done is None else done.unionByName(rest)
        live = materialize(live.join(sized_broadcast(cuts, split), "cell").select(
            "_key", "_v", (F.col("cell") * PARTS + part).alias("cell")), "cut-rows")


def _numpy(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t["_v"].combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return t["_key"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float)


def _meet(asking: DataFrame, asked: DataFrame, sizes: DataFrame, n_cells: int, k: int) -> DataFrame:
    """``src, dst, dist``: for rows that ask in a cell their ``k`` nearest of its rows."""
    from tabprep.operators.projection import nearest_rows

    chunk = lambda n: F.pmod(F.xxhash64("_key"), F.greatest(F.ceil(n / F.lit(CHUNK_ROWS)), F.lit(1)).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / F.lit(CHUNK_ROWS)), F.lit(1)).cast("long") - 1))
    asks = materialize(asking.groupBy("cell").agg(F.count("*").alias("m")), "asks").join(sizes.select("cell", "n"), "cell")
    side = sized_broadcast(asks, n_cells)
    left = asking.join(side, "cell").select("cell", chunk(F.col("m")).alias("qc"), every(F.col("n")).alias("cc"), "_key", "_v")
    right = asked.select("cell", "_key", "_v").join(side, "cell").select("cell", every(F.col("m")).alias("qc"), chunk(F.col("n")).alias("cc"), "_key", "_v")
    right = right.select(*[F.col(c).alias(f"to_{c}") for c in right.columns])  # both sides may come from the same rows

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        qk, qv = _numpy(q)
        ck, cv = _numpy(c.rename_columns([n.removeprefix("to_") for n in c.column_names]))
        return pa.table(dict(zip(("src", "dst", "dist"), nearest_rows(qv, qk, cv, ck, k))))
    keys = ("cell", "qc", "cc")
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"to_{c}" for c in keys])).applyInArrow(run, "src long, dst long, dist double")


def _best(lists: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _to_box(far: bool) -> Column:
    """The distance from ``_v`` to the nearest (farthest) point of the box ``lo, hi``."""
    def gap(v, lo, hi):
        return F.greatest(F.abs(v - lo), F.abs(v - hi)) if far else F.greatest(lo - v, v - hi, F.lit(0.0))
    z = F.arrays_zip(F.col("_v").alias("v"), F.col("lo").alias("l"), F.col("hi").alias("h"))
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.pow(gap(x["v"], x["l"], x["h"]), F.lit(2))))


def knn_cells(data: DataFrame, n: int, d: int, k: int, cell_rows: int | None = None, report: dict | None = None) -> DataFrame:
    """``src, dst, rank, dist`` for rows ``_key, _v`` of ``d`` dimensions: exact."""
    rows, rounds = space_tree(materialize(data.select(F.col("_key").cast("long").alias("_key"), "_v"), "points"), d, cell_rows or cell_size(n))
    n_cells = sum(count for _, count in rounds)
    leaves = None
    for cells, _ in rounds:
        some = cells.filter("leaf")
        leaves = some if leaves is None else leaves.unionByName(some)
    inside = materialize(_best(_meet(rows, rows, leaves, n_cells, k), k).drop("rank"), "inside")
    reach = inside.groupBy("src").agg(F.count("*").alias("found"), F.max("dist").alias("r"))
    # cells with too few rows: the box of the nearest cell above that has enough
    few = leaves.filter(F.col("n") <= k).select("cell", F.col("parent").alias("up"))
    enough, depth = None, len(rounds)
    for cells, _ in reversed(rounds):
        here = few.join(cells.select(F.col("cell").alias("up"), "n", "lo", "hi"), "up")
        ok = here.filter(F.col("n") > k).select("cell", "lo", "hi")
        enough = ok if enough is None else enough.unionByName(ok)
        few = few.join(ok.select("cell"), "cell", "left_anti")
        few = few.join(cells.select(F.col("cell").alias("up"), F.col("parent").alias("above")), "up", "left").select(
            "cell", F.coalesce("above", "up").alias("up"))
    enough = materialize(enough, "enough")
    radius = F.when(F.coalesce("found", F.lit(0)) >= k, F.col("r")).otherwise(F.coalesce(_to_box(True), F.lit(float("inf"))))
    asking = (rows.join(reach, rows["_key"] == reach["src"], "left").join(sized_broadcast(enough, n_cells), "cell", "left")
              .select("_key", "_v", F.col("cell").alias("own"), (radius * (1 + 1e-9) + 1e-12).alias("radius")))
    asking = materialize(asking, "asking").withColumn("at", F.lit(0).cast("long"))
    reached = None
    for cells, count in rounds:  # down the tree, a round at a time
        down = asking.join(sized_broadcast(cells.withColumnRenamed("parent", "at"), count), "at").filter(
            (_to_box(False) <= F.col("radius")) & ~(F.col("leaf") & (F.col("cell") == F.col("own"))))
        down = materialize(down.select("_key", "_v", "own", "radius", "cell", "leaf"), "down")
        some = down.filter("leaf").select("cell", "_key", "_v")
        reached = some if reached is None else reached.unionByName(some)
        asking = down.filter("not leaf").select("_key", "_v", "own", "radius", F.col("cell").alias("at"))
    reached = materialize(reached, "reached")
    if report is not None:
        pairs = reached.groupBy("cell").count().join(leaves.select("cell", "n"), "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        report.update(rows=n, pairs=pairs + leaves.agg(F.sum(F.col("n") * F.col("n"))).first()[0])
    across = _meet(reached, rows, leaves, n_cells, k)
    return _best(inside.unionByName(across), k).select("src", "dst", F.col("rank").cast("int").alias("rank"), "dist")
