"""Null columns, empty and very long texts, repeated rows, empty tables and
clashing column names; the ways beyond the size limits; the methods' own parts."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.llm import (chosen_path, decontaminate, language_id, personal, quality, sampled_pieces, secrets,
                         shingles, suffix_tree, token_counts, units, urlfilter)
from tabprep.llm import pieces as pc
from tests.llm import brute
from tests.llm.conftest import edge_rows


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("tkey", F.lit("x"))


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, items(s, [(1, edge_rows()[4][1]), (2, None), (3, "")])),
    "quality": lambda s, d: quality.judge(d),
    "suffix_tree": lambda s, d: suffix_tree.score(d),
    "token_counts": lambda s, d: token_counts.count_tokens(d),
    "personal": lambda s, d: personal.find_personal(d),
    "language_id": lambda s, d: language_id.identify(d),
    "chosen_path": lambda s, d: chosen_path.jaccard_classes(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_and_none_for_an_empty_table(spark, edge, empty, name):
    got = OPERATORS[name](spark, edge)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in edge_rows())
    assert OPERATORS[name](spark, empty).count() == 0


def test_defined_results_of_the_edges(spark, edge):
    rows = {r.doc_id: r for r in OPERATORS["decontaminate"](spark, edge).collect()}
    assert (rows[1].n_words, rows[1].n_hit) == (0, 0) and rows[5].n_hit == 10
    assert rows[8].n_hit == 30000 == rows[8].n_words and rows[4].n_hit == 0
    links = {r.doc_id: r for r in OPERATORS["chosen_path"](spark, edge).collect()}
    assert links[1].n_links == links[2].n_links == links[3].n_links == 0 and links[3].class_id == 3
    assert (links[6].n_links, links[6].class_id) == (2, 5)
    lang = {r.doc_id: r for r in OPERATORS["language_id"](spark, edge).collect()}
    assert [lang[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and lang[4].lang_pred != "und"
    tokens = {r.doc_id: r for r in OPERATORS["token_counts"](spark, edge).collect()}
    assert tokens[1].n_tokens == tokens[2].n_tokens == 0 and tokens[10].n_tokens > 100
    q = {r.doc_id: r for r in OPERATORS["quality"](spark, edge).collect()}
    assert q[1].base_failed and q[8].base_failed and q[8].n_repeat_words == 30000
    want = brute.unigram([(r[0] if r[0] is not None else "", r[1]) for r in edge_rows()])
    for r in OPERATORS["suffix_tree"](spark, edge).collect():
        if r.doc_id is not None:
            assert (r.held_out, r.n_tokens, r.n_known) == want[r.doc_id][:3]


def test_windows_beyond_the_broadcast_limit(spark, docs001, texts001):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").unionByName(
        spark.createDataFrame([(900, "and the of"), (901, "of")], "item_id long, text string"))
    rows = [(r.item_id, r.text) for r in bench.collect()]
    want = brute.contamination(texts001, rows)
    for limit in (0, 10 ** 6):
        for r in decontaminate.contamination(docs001, bench, broadcast_rows=limit).collect():
            assert (r.n_words, r.n_hit, len(r.item_ids)) == want[r.doc_id][:3]


def test_no_exchange_carries_the_words_beyond_the_limit(spark, docs001):
    grams = spark.createDataFrame([(i, 5) for i in range(1000)], "key long, k int")
    base = docs001.select("doc_id", decontaminate.text_key("text", "doc_id").alias("tkey"), decontaminate.word_array("text").alias("w"))
    rows = decontaminate.candidate_positions(base, grams, [5], [10], False, 1000)
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    inputs = [part.split("\n")[1] for part in re.split(r"\n\(\d+\) ", plan) if part.startswith("Exchange")]
    assert inputs and all(re.search(r"\[(.*)\]", i) and not re.search(r"\bw#", i) for i in inputs), inputs


def test_many_short_sets_in_one_bucket(spark):
    """A hot template: thousands of short sets that share a bucket are compared in chunks."""
    docs = [(i, f"one two three four five x{i}") for i in range(3000)] + [(9000 + i, "one two three four five six") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.jaccard_classes(df, bucket_members=400).collect()}
    assert all(got[i] == (i, 0) for i in range(3000)) and all(got[9000 + i] == (9000, 8) for i in range(9))


def test_chosen_path_with_small_buckets_and_chunks(spark, docs001, texts001):
    want = brute.jaccard(texts001)
    got = chosen_path.jaccard_classes(docs001, small=2, bucket_tokens=300, bucket_members=3)
    assert all((r.n_links, r.class_id, r.n_shingles) == want[r.doc_id] for r in got.collect())


def test_chosen_path_on_a_dense_group(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(160)]
    docs = []
    for i in range(150):
        w = list(words)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(words[:12] + [f"y{i}_{k}" for k in range(100)])) for i in range(100)]
    want = brute.jaccard(docs)
    got = chosen_path.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), small=16,
                                      bucket_tokens=4000).collect()
    assert [r for r in got if (r.n_links, r.class_id, r.n_shingles) != want[r.doc_id]] == []


def test_intersections_and_runs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 10 ** 6, 30)).astype(np.uint64)] * 2
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (chosen_path.intersections(sets) == want).all()
    assert (chosen_path.intersections(sets[:10], sets[10:]) == np.array(want)[:10, 10:]).all()
    assert chosen_path.runs_for(0.9999, 0.8, 1.25, 3) == 17


def test_shingle_sets_follow_the_words():
    texts = ["", "One two", "one  TWO", "a b c d e f", "A-b c.d e\nf", "ünï 漢 x y z w", "a b c d e " * 50]
    got = shingles.shingle_sets(texts * 3)
    assert [len(s) for s in got[:7]] == [len(brute.shingles(t)) for t in texts]
    assert (got[1] == got[2]).all() and (got[3] == got[4]).all() and (got[5] == got[12]).all()


def test_bloom_filter_passes_all_listed_and_the_join_removes_the_rest(spark):
    urls = spark.createDataFrame([(f"h{i}.example/p/{i}",) for i in range(3000)], "canon string")
    listed = urls.limit(0).unionByName(urls.filter(F.crc32("canon") % 3 == 0))
    want = {r.canon for r in listed.collect()}
    for bits in (1, 16):  # at one bit per URL most blocks are full, so the exact join has work to do
        assert {r.canon for r in urlfilter.listed_urls(urls, listed, bits_per_url=bits).collect()} == want
    pages = spark.createDataFrame([(1, "HTTPS://WWW.Bad.example.NET:80/x/index.html?utm_a=1&b=2#t"), (2, None),
                                   (3, "no scheme"), (4, "http://a.b.org/q"), (5, "http://"), (5, "http://")],
                                  "page_id long, url string").withColumn("canon", F.lit("x")).withColumn("host", F.lit(1))
    black = spark.createDataFrame([("bad.example.net/x?b=2",), (None,)], "canon string")
    rules = [("org", "/", "allow"), ("b.org", "/q", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, black, rules).collect()}
    assert got[1] == ("www.bad.example.net:80", "/x/index.html", None, "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4][2:] == ("b.org/q", "block")
    assert urlfilter.judge(pages.limit(0), black, rules).count() == 0


def test_ownership_separates_copies_from_live_values(spark):
    live, wide = "k9Q2mZx81LpR4tVb7Yc3", "EXAMPLEkey1234567890abcd"
    docs = [(i, f"use token = {wide} here", "en", f"s{i}") for i in range(8)]
    docs += [(20, f'password: "{live}"', "en", "s1"), (21, f"again {live} bare", "en", "s1"),
             (22, "bare Zz81LpR4tVb7Yc3aaQ97 alone", "de", "s2"), (23, f"bare {wide} copy", "en", "s3"), (24, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert [c["class"] for c in got[0].classes] == ["example"] and got[23].live == []
    assert [c["class"] for c in got[20].classes] == ["live"]
    assert [(s.start, s.end) for s in got[21].live] == [(6, 26)] and len(got[22].live) == 1
    clean = {r.doc_id: r.text for r in secrets.redact(df.withColumn("tkey", F.lit(1)).withColumn("x", F.lit(2))).collect()}
    assert live not in clean[20] + clean[21] and wide in clean[0] and wide in clean[23] and clean[24] is None
    assert clean[21] == "again [SECRET] bare"


def test_many_matches_in_one_text_are_linear(spark):
    n = 100_000
    text = "".join(f"Zz81LpR4tVb7{i:06d}Yc3aaQ é " for i in range(n)) + "token = k9Q2mZx81LpR4tVb7Yc3"
    df = spark.createDataFrame([(1, text, "en", "s1"), (2, "x", "en", "s2")], "doc_id long, text string, lang string, source string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(df).select(
        "doc_id", F.size("live").alias("n"), F.size("base").alias("b"), F.try_element_at("live", F.lit(-1)).alias("last")).collect()}
    assert (got[1].n, got[1].b, got[2].n) == (n, 1, 0) and got[1].last.end == (n - 1) * 27 + 24
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[1] == "[SECRET] é " * n + "[SECRET]" and clean[2] == "x"
    assert time.time() - began < 60


def test_repositories_decide_too(spark):
    live = "k9Q2mZx81LpR4tVb7Yc3"
    docs = [(i, f"token = {live}{'abcd'[k]}", f"r{i}", "s1") for k, n in enumerate((2, 5, 12)) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = secrets.find_secrets(df).select("base", "classes").collect()
    assert {r.base[0].value[-1]: r.classes[0]["class"] for r in got} == {"a": "live", "b": "shared", "c": "example"}


STAGES = {
    "redact": lambda s, d: secrets.redact(d),
    "one_per_class": lambda s, d: chosen_path.one_per_class(d),
    "keep_identified": lambda s, d: language_id.keep_identified(d),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, items(s, [(1, edge_rows()[4][1])])),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, edge, empty, name):
    """The kept rows are those that the same stage keeps without further columns."""
    plain = STAGES[name](spark, edge.select("doc_id", "text", "lang", "source"))
    clash = edge.withColumns({c: F.lit(8) for c in ("_tkey", "_text_key", "_twice", "_cuts", "cuts", "changed", "row.x", "doc", "spans")})
    got = STAGES[name](spark, clash)
    assert got.columns == clash.columns
    rows = [r.asDict() for r in got.collect()]
    assert all(r["_tkey"] == r["cuts"] == r["row.x"] == 8 and r["tkey"] == 7 for r in rows)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows)) == sorted((str(r.doc_id), str(r.text)) for r in plain.collect()) and rows
    assert STAGES[name](spark, empty).count() == 0


def test_very_long_digit_runs_are_no_address(spark):
    texts = ["x " + "0" * 5000 + ".1.1.1 y", "0" * 5000 + "9" * 5000 + ".1.2.3", "000255.001.0.00"]
    want = [[f"{k}:{s}:{e}" for s, e, k in sorted(brute.personal_spans(t))] for t in texts]
    assert [len(w) for w in want] == [1, 0, 1]
    got = personal.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[s for s in r.spans if not s.startswith("term")] for r in sorted(got)] == want


def test_terms_that_disclose_an_entity_are_removed(spark):
    docs = [(i, f"note {i} the falcon9 mail bob.{0}@corp.example.com said {i + 1}") for i in range(12)]
    docs += [(100 + i, f"the mail note of day {i} said nothing new") for i in range(200)]
    docs += [(500, "an old falcon9 memo"), (501, None), (502, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn(
        "entity", F.lit(1))
    got = {r.doc_id: r for r in personal.find_personal(df).collect()}
    assert [s.split(":")[0] for s in got[0].spans] == ["term", "email"]
    assert [s.split(":")[0] for s in got[500].spans] == ["term"] and "falcon9" not in got[500].sanitised
    assert got[100].spans == [] and got[100].sanitised == docs[12][1]
    assert "[EMAIL]" in got[0].sanitised and " the " in got[0].sanitised


def test_base_spans_equal_the_patterns_on_random_text():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("ab1.@-_+ 2905()\n%") for _ in range(rng.randint(0, 40)))
        want = sorted((s, personal.KINDS.index(k), e) for s, e, k in brute.personal_spans(text))
        assert personal.base_spans(text) == want


def _segmentations(word, pieces, alpha):
    if not word:
        yield (), 0.0
    for n in range(1, min(len(word), pieces.longest) + 1):
        s, ids = pieces.scores.get(word[:n]), None
        if s is not None:
            ids = (pieces.ids[word[:n]],)
        elif n == 1:
            raw = word[0].encode()
            s, ids = pc.BYTE_SCORE * len(raw), tuple(pieces.byte_ids[b] for b in raw)
        if ids:
            for rest, t in _segmentations(word[n:], pieces, alpha):
                yield ids + rest, alpha * s + t


def test_samples_are_distinct_unbiased_and_independent_of_the_batch():
    pieces, alpha, text, n = pc.load(), 0.1, "ab é▁", 6000
    parts = [list(_segmentations(pc.SPACE + w, pieces, alpha)) for w in pc.pre_tokens(text)]
    all_of = {sum((p[0] for p in c), ()): sum(p[1] for p in c) for c in itertools.product(*parts)}
    z = np.logaddexp.reduce(list(all_of.values()))
    vocab = sampled_pieces.Vocabulary(pieces)
    lat = sampled_pieces.Lattices(vocab, alpha)
    found = sampled_pieces.sample_block([text] * n, np.arange(n), 3, lat)
    first, estimate = {}, 0.0
    for rows in found:
        ids = [tuple(sampled_pieces.to_ids(r[0], vocab).tolist()) for r in rows]
        assert len(set(ids)) == 3 and all(pc.decode(i, pieces) == text for i in ids)
        assert all(r[1] == pytest.approx(all_of[i] - z, abs=1e-6) for i, r in zip(ids, rows))
        first[ids[0]] = first.get(ids[0], 0) + 1
        estimate += sum(math.exp(r[1]) / r[3] * len(i) for i, r in zip(ids, rows)) / n
    for i, v in all_of.items():
        assert first.get(i, 0) / n == pytest.approx(math.exp(v - z), abs=0.03)
    assert estimate == pytest.approx(sum(math.exp(v - z) * len(i) for i, v in all_of.items()), rel=0.02)
    everything = sampled_pieces.sample_block([text], np.arange(1), 50, lat)[0]
    assert len(everything) == len(all_of) and all(r[3] == 1.0 for r in everything)
    a = sampled_pieces.sample_block(["hello world foo", "abc"], np.array([5, 6]), 3, lat)[0]
    b = sampled_pieces.sample_block(["zzz", "hello world foo"], np.array([9, 5]), 3, lat)[1]
    assert all((x[0] == y[0]).all() and x[1:] == y[1:] for x, y in zip(a, b))


def test_sampled_edges(spark, edge, empty):
    got = {}
    for r in sampled_pieces.sample(edge).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.round_trip
    assert set(got) == {r[0] for r in edge_rows()}
    assert [(r["rank"], list(r.ids), r.inclusion) for r in got[1]] == [(1, [], 1.0)]
    assert len(got[5]) == 6 and len({tuple(r.ids) for r in got[5]}) == 3
    assert sampled_pieces.sample(empty).count() == 0


def test_trie_shares_prefixes_and_survives_a_reset(monkeypatch, texts001):
    pieces = pc.load()
    vocab = sampled_pieces.Vocabulary(pieces)
    words = sorted({pc.SPACE + w for w in ["then", "thenceforth", "the", "thé", "▁x", "", "漢字", "a\nb", "\ue000x", "😀"]})
    score, tokens, nodes = token_counts.trie_scores(words, vocab)
    prefixes = {w[:n] for w in words for n in range(1, len(w) + 1)}
    assert nodes == len(prefixes)
    for w, s, n in zip(words, score, tokens):
        assert (s, n) == token_counts.walk(w, pieces)
    texts = [t or "" for _, t in texts001] + ["x" * 100 + " " + "é" * 60]
    whole = [np.concatenate(x) for x in zip(*token_counts.Counter(pieces).count(texts))]
    monkeypatch.setattr(units, "MAX_UNITS", 50)
    monkeypatch.setattr(token_counts, "TRIE_WORDS", 7)
    small = token_counts.Counter(pieces)
    parts = [np.concatenate(x) for x in zip(*(y for t in texts for y in small.count([t])))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_codewords_and_many_languages():
    for n in (2, 3, 6, 9, 30):
        m = language_id.codewords([f"l{i}" for i in range(n)])
        assert len({tuple(r) for r in m}) == n and all(abs(c.sum()) < n for c in m.T)
    one = language_id.codewords(["x"])
    best, share, _ = language_id.decode(np.zeros((2, 0)), one, one)
    assert (best == 0).all() and (share == 1).all()


def test_suffix_tree_scores_are_finite_and_negative(spark):
    docs = spark.createDataFrame([(i, "a b a b c a b" if i % 2 else "b a c c a") for i in range(40)],
                                 "doc_id long, text string")
    # every continuation of a text's first word, and the end, under the model learned from the same rows
    words = ["a", "b", "c", "zzz"]
    probe = docs.filter("doc_id = 0").limit(0).unionByName(spark.createDataFrame(
        [(-1, f"a {w}") for w in words] + [(-2, "a")], "doc_id long, text string"))
    assert all(brute.crc(i) % 7 != 2 or i for i in (-1, -2))
    got = suffix_tree.score(docs.unionByName(probe)).filter("doc_id < 0").collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_divergence_rejects_symbols_and_keeps_prose(spark, docs001):
    good = docs001.filter(F.length("text") > 800)
    noise = spark.createDataFrame([(10 ** 6 + i, " ".join(f"{chr(97 + k % 26)}{k}###" for k in range(i * 31, i * 31 + 300)),
                                    "en") for i in range(5)], "doc_id long, text string, lang string")
    got = quality.judge(good.select("doc_id", "text", "lang").unionByName(noise)).collect()
    assert not any(r.kept for r in got if r.doc_id >= 10 ** 6)
    unlabelled = quality.judge(noise.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.class_distance is None and r.kept for r in unlabelled)
