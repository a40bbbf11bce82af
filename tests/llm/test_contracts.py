"""The queries against plain Python, on the whole small tables."""

import duckdb
import pytest

from tabprep.llm import pieces as pc
from tabprep.llm import queries as q
from tests.conftest import SF001
from tests.llm import brute


def rows(spark, name):
    return q.QUERIES[name](spark, SF001).collect()


def test_decontaminate(spark, texts001):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = brute.contamination(texts001, items)
    got = rows(spark, "op1_decontaminate")
    assert len(got) == len(texts001) and any(r.contaminated for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]


def test_quality(spark, texts001):
    want = {i: brute.quality(t) for i, t in texts001}
    got = rows(spark, "op2_quality")
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.7 * len(got)


def test_suffix_tree(spark, texts001):
    want = brute.unigram(texts001)
    got = rows(spark, "op3_suffix_tree")
    assert len(got) == len(texts001)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_token_counts(spark, texts001):
    pieces, texts = pc.load(), dict(texts001)
    got = rows(spark, "op4_token_counts")
    assert len(got) == len(texts001)
    for r in got:
        score, n = brute.best_segmentation(texts[r.doc_id] or "", pieces)
        assert r.score == pytest.approx(score, rel=1e-9)
        assert n == r.n_tokens and r.n_pre_tokens == (len(texts[r.doc_id].split(" ")) if texts[r.doc_id] else 0)


def test_personal(spark, texts001):
    want = {i: brute.personal_spans(t) for i, t in texts001}
    kinds = ["email", "ip", "card", "phone"]
    for r in rows(spark, "op5_personal"):
        base = brute.joined(want[r.doc_id], kinds)
        assert r.base_sha256 == brute.sha(base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in want[r.doc_id]) for k in kinds]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s in base.split(",") if s]


def test_sampled_pieces(spark, texts001):
    got = rows(spark, "op6_sampled_pieces")
    per_doc = {}
    for r in got:
        assert r.round_trip and r.log_prob <= 1e-9 and 0 <= r.inclusion <= 1
        per_doc.setdefault(r.doc_id, []).append(r)
    assert set(per_doc) == {i for i, _ in texts001}
    for mine in per_doc.values():
        mine.sort(key=lambda r: r["rank"])
        assert len({r.ids_hash for r in mine}) == len(mine) == 3
        assert all(a.perturbed >= b.perturbed for a, b in zip(mine, mine[1:]))


def test_language_id(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = rows(spark, "op7_language_id")
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_chosen_path(spark, texts001):
    want = brute.jaccard(texts001)
    for r in rows(spark, "op8_chosen_path"):
        assert (r.n_links, r.class_id, r.n_shingles) == want[r.doc_id]


def test_url_filter(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF001}/pages.parquet'")
    want = {r[0]: r for r in con.execute(q.ORACLE["op9_urlfilter"]).fetchall()}
    got = rows(spark, "op9_urlfilter")
    assert len(got) == len(want)
    for r in got:
        assert (r.page_id, r.host, r.path, r.rule, r.verdict) == want[r.page_id]


def test_secrets(spark, texts001):
    kinds = ["assign", "access", "hex"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF001}/documents.parquet'")
    found = con.execute(q.ORACLE["op10_secrets"])
    names = [d[0] for d in found.description]
    sql = {r[0]: dict(zip(names, r)) for r in found.fetchall()}
    want = {i: brute.secret_spans(t) for i, t in texts001}
    for r in rows(spark, "op10_secrets"):
        base = brute.joined(want[r.doc_id], kinds)
        assert r.base_sha256 == brute.sha(base)
        assert r.asDict() == sql[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in want[r.doc_id]) for k in kinds]
        assert [s for s in r.spans.split(",") if s and not s.startswith("live:")] == [s for s in base.split(",") if s]
