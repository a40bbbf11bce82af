"""Blocks of the kNN graph in many dimensions: bounded in the task, exact however they are cut."""

import tracemalloc

import numpy as np
import pytest

from tabprep.operators import projection


def points(n, seed=5, d=8):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, d)), 1).astype(np.float32).astype(float)


def brute(keys, v, k):
    out = set()
    for i, key in enumerate(keys):
        others = [j for j in range(len(keys)) if keys[j] != key]
        dist = {j: float(np.sqrt(((v[j] - v[i]) ** 2).sum())) for j in others}
        for rank, j in enumerate(sorted(others, key=lambda j: (dist[j], keys[j]))[:k], 1):
            out.add((key, keys[j], rank, round(dist[j], 6)))
    return out


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
@pytest.mark.parametrize("block_rows", [None, 7, 64])
def test_blocks_of_any_size_give_the_same_graph(spark, kind, block_rows):
    v = points(150)
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], f"id long, v {kind}")
    got = projection.knn_graph(df, "v", 4, key="id", block_rows=block_rows).collect()
    assert {(r.src, r.dst, r["rank"], round(r.dist, 6)) for r in got} == brute([i * 3 for i in range(150)], v, 4)


def test_fewer_candidates_than_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i)] * 8) for i in range(3)], "id long, v array<double>")
    got = projection.knn_graph(df, "v", 5, key="id", block_rows=1).collect()
    assert len(got) == 6 and {r["rank"] for r in got} == {1, 2}


def test_rows_are_repeated_for_their_blocks_by_spark(spark):
    """A Python batch held every copy of its rows, twice the number of blocks."""
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points(60))], "id long, v array<double>")
    p = projection.knn_graph(df, "v", 3, key="id", block_rows=5)._jdf.queryExecution().executedPlan().toString()
    assert "explode(" in p and "FlatMapGroups" not in p


def test_a_block_holds_its_queries_not_its_candidates():
    k, v, more = 5, points(500, d=16), points(60_000, 6, 16)
    block = projection._Block(k)
    yes = np.ones(500, bool)
    block.add(np.arange(500), v, yes, ~yes)
    block.add(np.arange(500, 600), v[:100], ~yes[:100], yes[:100])  # a small batch first: a loose bound
    tracemalloc.start()
    for a in range(0, 60_000, 10_000):
        one = np.ones(10_000, bool)
        block.add(np.arange(1000 + a, 11_000 + a), more[a: a + 10_000], ~one, one)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    every, keys = np.concatenate((v[:100], more)), np.append(np.arange(500, 600), np.arange(1000, 61_000))
    got = [(r["src"], r["dst"]) for b in block.rows() for r in b.to_pylist()]
    want = []
    for i in range(500):
        dist = np.sqrt(((every - v[i]) ** 2).sum(1))
        want += [(i, int(keys[j])) for j in np.lexsort((keys, dist))[:k]]
    assert got == want


def test_repeated_keys_are_not_their_own_neighbours(spark):
    v = points(40)
    df = spark.createDataFrame([(i // 2, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = projection.knn_graph(df, "v", 3, key="id", block_rows=6).collect()
    assert {r.src for r in got} == set(range(20)) and all(r.src != r.dst for r in got)
