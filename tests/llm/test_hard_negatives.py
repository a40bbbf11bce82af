"""Hard negatives against all products, and the certain bounds of the codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.llm import hard_negatives as hn
from tabprep.llm import queries
from tests.conftest import SF001


def brute(rows, every=50):
    """rows: ``{id: (label, integer vector)}``."""
    d = max((len(v) for _, v in rows.values()), default=0)
    full = {i: (l, np.array([*v, *[0] * (d - len(v))], dtype=object)) for i, (l, v) in rows.items()}
    out = []
    for a, (label, v) in full.items():
        if a % every:
            continue
        score = {i: int((v * w).sum()) if d else 0 for i, (_, w) in full.items() if i != a}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in first([i for i in score if full[i][0] == label])[:5]:
            fit = [i for i in score if full[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(first(fit)[:3], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_equals_all_products(spark):
    want = {}
    for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        want[r.vec_id] = (label, [int(np.floor(256 * float(x))) for x in r.embedding])
    got = rows_of(queries.QUERIES["op12_hard_negatives"](spark, SF001))
    assert got == brute(want) and len(got) > 10


@pytest.mark.parametrize("blocks", [(8192, 4096), (40, 7)])
def test_ties_repeats_nulls_short_and_large_vectors(spark, blocks):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(-20, 300):
        v = rng.integers(-2, 3, 6 if i % 4 else 3).astype(float).tolist() if i % 5 else [1.0, 1.0, 0.0, 0.0, 0.0, 1.0]
        if i % 29 == 1:
            v[0] = 300000.0 * (1 if i % 2 else -1)
        rows.append((i, v, i % 3))
        want[i] = (i % 3, [int(256 * x) for x in v])
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")], 1), (403, [float("inf")], 1), (404, [1e9], 1),
             (405, [1.0], None), (None, [1.0], 1), (406, [], 1), (50, rows[70][1], rows[70][2])]
    assert rows[70][0] == 50
    want[406] = (1, [])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn(
        "id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("rank", F.lit(3)).repartition(5)
    got = rows_of(hn.mine(df, anchor=F.col("id") % 10 == 0, block_rows=blocks[0], block_anchors=blocks[1]))
    assert got == brute(want, every=10) and len(got) > 100


def test_nothing_from_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.mine(df).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hn.mine(one).count() == 0


@pytest.mark.parametrize("d", [64, 128])
def test_bounds_are_certain_and_leave_rows_out(d):
    rng = np.random.default_rng(d)
    turn = hn.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d))
    v = np.floor(256 * rng.standard_normal((3000, d)) / np.sqrt(d)).astype(np.int64)
    v[:50] = v[50:100]
    v[200], v[201], v[202] = 0, 10 ** 6, -v[0]
    asked, codes = hn.Asked(v[:100], turn), hn.Codes(v, turn)
    low, high = hn.intervals(asked, codes)
    exact = v[:100] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.partition(exact[:, 300:], -6, axis=1)[:, -6]
    assert (high[:, 300:] < fifth[:, None]).mean() > 0.5  # most rows never need their product
