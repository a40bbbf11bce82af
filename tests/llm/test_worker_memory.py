"""What the text passes hold and do at a time does not depend on how many texts a batch has."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tabprep import session
from tabprep.llm import chosen_path, common, language_id, pieces, sampled_pieces


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def some_texts(n, words):
    rng = random.Random(5)
    return [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words)) for _ in range(n)]


def test_margins_hold_few_features_at_a_time():
    texts = some_texts(900, 300)
    weights = np.random.default_rng(1).standard_normal((language_id.FEATURES, 15)).astype(np.float32)
    mb, got = peak_mb(lambda: language_id.margins(texts, weights))
    assert sum(map(len, texts)) > 2_000_000 and mb < 60
    assert all((got[i] == language_id.margins([texts[i]], weights)[0]).all() for i in (0, 450, 899))


def test_intersections_hold_few_pairs_at_a_time():
    rng = np.random.default_rng(2)
    owners = rng.random((60_000, 200)).argpartition(10, axis=1)[:, :10]  # every token is in ten of the sets
    sets = [np.flatnonzero((owners == i).any(axis=1)).astype(np.uint64) for i in range(200)]
    mb, got = peak_mb(lambda: chosen_path.intersections(sets))
    assert mb < 50
    for i, j in ((0, 1), (7, 150), (199, 3)):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_sketches_come_in_slices_of_a_batch():
    texts = ["", *some_texts(30, 40), "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), pa.array(map(str, texts))],
                                       ["text", "doc_id", "tkey"])
    run = chosen_path._sketch(3, chosen_path.RATE, 5, chosen_path.LEVELS)
    whole = pa.Table.from_batches(run([batch]))
    held, chosen_path.BLOCK_BYTES = chosen_path.BLOCK_BYTES, 700
    try:
        parts = list(run([batch]))
    finally:
        chosen_path.BLOCK_BYTES = held
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_sampling_holds_a_block_of_a_batch():
    texts = ["", *some_texts(800, 100), "one"]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), pa.array(map(str, texts))],
                                      ["text", "seed", "doc_id"])

    class Loaded:
        value = pieces.load()

    run, held = sampled_pieces._sampler(Loaded, 3, sampled_pieces.ALPHA), sampled_pieces.BLOCK_CHARS
    mb, got = peak_mb(lambda: [len(b) for b in run([rows])])
    assert sum(map(len, texts)) > 500_000 and len(got) > 2 and sum(got) == 3 * len(texts) - 2 and mb < 130
    some = rows.slice(0, 40)
    whole = pa.Table.from_batches(run([some]))
    sampled_pieces.BLOCK_CHARS = 900
    try:
        parts = list(run([some]))
    finally:
        sampled_pieces.BLOCK_CHARS = held
    assert len(parts) > 20 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_batches_of_texts_are_bounded_in_the_pipeline(spark, monkeypatch):
    def counted(*_):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), pa.array([n] * n, pa.int32()), pa.array([[1]] * n, pa.list_(pa.int32())),
                     *(pa.array([0.0] * n) for _ in range(3)), pa.array([True] * n)],
                    ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])
        return run

    monkeypatch.setattr(sampled_pieces, "_sampler", counted)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(2 * common.BATCH_ROWS + 7, numPartitions=1).selectExpr("id as doc_id", "'some text' as text")
    got = [r["rank"] for r in corpus_pipeline.sample_segmentations(spark, docs, "").select("rank").collect()]
    assert len(got) == 2 * common.BATCH_ROWS + 7 and max(got) <= common.BATCH_ROWS
    assert spark.conf.get(name) == before


def test_a_smaller_batch_of_the_session_is_kept(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 5)
        with session.arrow_rows(spark, 100):
            assert spark.conf.get(name) == "5"
        with session.arrow_rows(spark, 3):
            assert spark.conf.get(name) == "3"
        assert spark.conf.get(name) == "5"
    finally:
        spark.conf.set(name, before)


def test_a_pass_gives_back_what_it_freed(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.released(lambda batches: (2 * x for x in batches))([1, 2])) == [2, 4] and given == [1]
