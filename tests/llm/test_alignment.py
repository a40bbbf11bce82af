"""Cross-tokenizer alignment against whole-text encodings and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabprep.llm import alignment, byte_pairs, pieces, queries, units
from tests.conftest import SF001
from tests.llm.conftest import edge_rows

SIGNS = [*"ab  \n\n\t\r'st1", " ", "é", "漢", "字", " ", *"!.-", "😀", *"ll", "▁", "<|endoftext|>", "<s>", "<0x41>",
         " the", ";\r", "}\r\n", "   ", "1234"]


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(byte_pairs.TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    a.encode_special_tokens = True
    own = alignment.Tokenizers(*alignment._files(byte_pairs.TOKENIZER, pieces.MODEL))

    def groups(text):
        """The groups ``(ids of A, ids of B)`` of a text."""
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(own.raw_a[t] for t in x) == (" " + text).encode() == b"".join(own.raw_b[t] for t in y):
            return []
        ends = [np.cumsum([len(r[t]) for t in z]).tolist() for r, z in ((own.raw_a, x), (own.raw_b, y))]
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            out.append((x[i:p], y[j:q]))
            i, j = p, q
        return out

    def table(texts):
        cut = [groups(t) for t in texts]
        links = [Counter((p, q) for x, y in g for p in x for q in y) for g in cut]
        count = Counter(k for c in links for k in c)
        best = {}
        for (p, _), n in count.items():
            best[p] = max(best.get(p, 0), n)
        out = []
        for g, c in zip(cut, links):
            line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                        sum(n for k, n in c.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in c.items()), line))
        return out
    return table


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def test_query_equals_brute_force(spark, brute, texts001):
    want = brute([t for _, t in texts001])
    got = {r.doc_id: r for r in queries.QUERIES["op11_alignment"](spark, SF001).collect()}
    assert len(got) == len(texts001) and sum(w[2] for w in want) > 10_000
    for (doc_id, _), (*numbers, line) in zip(texts001, want):
        r = got[doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(line.encode()).hexdigest() if line else "")


@pytest.mark.parametrize("share", [0.0, 0.01, 2.0])
def test_random_texts_and_the_shuffled_counts(spark, brute, share, monkeypatch):
    """At a share of 2 all counts come from the join, at 0.01 some."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["x" * 3000, " ", "  ", "\n", "a ", None, "", "１２３ ７", "abc " * 500, "漢字" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit(1)).withColumn(
        "pair", F.lit(1)).repartition(3)
    want = sorted((str(i), *w) for i, w in enumerate(brute(texts)))
    assert rows_of(alignment.align(df, heavy_share=share)) == want


def test_bounded_steps_change_nothing(monkeypatch, brute):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    files = alignment._files(byte_pairs.TOKENIZER, pieces.MODEL)

    def links():
        aligner, out = alignment.Aligner(*files), Counter()
        for t in texts:
            for _, _, which, counts, _ in aligner.texts([t]):
                _, pair, n = aligner.per_text(which, counts, aligner.pairs, aligner.times.all)
                out.update(dict(zip(pair.tolist(), n.tolist())))
        return out
    whole = links()
    monkeypatch.setattr(alignment, "EXPANDED", 3)
    monkeypatch.setattr(alignment, "ALIGN_CHARS", 5)
    monkeypatch.setattr(units, "MAX_UNITS", 20)
    assert links() == whole and len(whole) > 100


def test_pointers_reach_the_common_ends():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for p in rng.random(2)]
        common = np.intersect1d(*ends)
        got = ends[1][alignment.terminals(*ends)]
        every = np.concatenate(ends)
        assert (got == common[np.searchsorted(common, every)]).all()


def test_edges(spark, brute, edge, empty):
    got = rows_of(alignment.align(edge))
    want = brute([r[1] for r in edge_rows()])
    assert got == sorted((str(r[0]), *w) for r, w in zip(edge_rows(), want))
    assert alignment.align(empty).count() == 0


def test_units_are_encoded_in_runs_as_one_by_one(monkeypatch):
    import random

    import numpy as np

    from tabprep.llm import alignment, units
    both = alignment.Tokenizers(*alignment._files(alignment.TOKENIZER, alignment.MODEL))
    rng, parts = random.Random(3), ["a", "the", "\n", " ", "\t", "\u2581", "\u00e9", "\u6f22", "<s>", "x1", "...", "\r", "\u3000", " b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400)]
    fresh = list(dict.fromkeys(u for t in texts for u in units.UNIT.findall(" " + t)))
    want = [x for lists in (both._a(fresh), both._b(fresh)) for x in alignment._ragged(lists)]
    for got, wanted in zip(both.encode(fresh, np.array([len(u.encode()) for u in fresh])), want):
        assert np.array_equal(got, wanted)
    sent, plain = [], both._a
    monkeypatch.setattr(both, "_a", lambda runs: sent.append(len(runs)) or plain(runs))
    words = [f" word{i}" for i in range(2000)]
    both.encode(words, np.array([len(u) for u in words]))
    assert sent == [-(-2000 // alignment.RUN)]          # one text a run, not one a unit


def test_each_text_is_encoded_once(spark, brute):
    """The corpus counts and the look-ups take the written id pairs, not the texts."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(counting, "doc_id long, text string")
    got = rows_of(alignment.align(df, heavy_share=0.01))
    assert seen.value == len(texts)
    assert got == sorted((str(i), *w) for i, w in enumerate(brute(texts)))
