"""Byte-level BPE against the file's own library."""

import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from tabprep.llm import byte_pairs, queries, units
from tests.conftest import SF001
from tests.llm.conftest import edge_rows

SIGNS = [*"ab  \n\n\t\r'st1", " ", "٣", "é", "漢", "字", " ", "\x1c", "\x85", *"!.-", "😀", "Ք՘", *"ll",
         "​", "▁", "<|endoftext|>", "'ll", " the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_pairs.TOKENIZER)


@pytest.fixture(scope="module")
def source():
    with open(byte_pairs.TOKENIZER, encoding="utf-8") as f:
        return f.read()


def encoded(encoder, texts):
    out = []
    for _, _, ids, counts in encoder.encode(texts):
        at = 0
        for n in counts.tolist():
            out.append(ids[at: at + n].tolist())
            at += n
    return out


def test_random_texts_equal_the_library(library, source, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000, "", "<|endoftext|>", "\n" * 999 + "x"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = byte_pairs.Encoder(source)
    assert encoded(encoder, texts) == want
    assert [byte_pairs.decode(w, encoder.merges.raw) for w in want] == texts
    library.encode_special_tokens = True
    plain = [library.encode(t, add_special_tokens=False).ids for t in texts]
    library.encode_special_tokens = False
    assert encoded(byte_pairs.Encoder(source, specials=False), texts) == plain
    # small blocks, single steps and a table that is dropped again and again change nothing
    monkeypatch.setattr(byte_pairs, "FEW", 10 ** 9)
    monkeypatch.setattr(byte_pairs, "INDEX_CHARS", 40)
    monkeypatch.setattr(units, "MAX_UNITS", 50)
    small = byte_pairs.Encoder(source)
    assert [ids for t in texts[:500] for ids in encoded(small, [t])] == want[:500]


def test_units_cut_where_no_token_crosses(library):
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(SIGNS[:-3]) for _ in range(rng.randint(0, 40)))
        cut = units.UNIT.findall(text)
        assert "".join(cut) == text
        whole = [p for p, _ in library.pre_tokenizer.pre_tokenize_str(text)]
        assert whole == [p for u in cut for p, _ in library.pre_tokenizer.pre_tokenize_str(u)]


def test_query_equals_the_library(spark, library, texts001):
    got = {r.doc_id: r for r in queries.QUERIES["op13_byte_pairs"](spark, SF001).collect()}
    assert len(got) == len(texts001)
    for doc_id, text in texts001:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[doc_id].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_edges(spark, edge, empty):
    got = byte_pairs.encode(edge)
    assert got.columns == ["doc_id", "ids", "decoded"]
    rows = sorted((str(r.doc_id), r.decoded) for r in got.collect())
    assert rows == sorted((str(r[0]), r[1] or "") for r in edge_rows())
    assert byte_pairs.encode(empty).count() == 0


def test_files_that_do_not_fit_are_refused(source):
    file = json.loads(source)
    file["model"]["merges"][5], file["model"]["merges"][45000] = file["model"]["merges"][45000], file["model"]["merges"][5]
    with pytest.raises(ValueError):
        byte_pairs.parse(json.dumps(file))
    other = json.loads(source)
    other["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError):
        byte_pairs.parse(json.dumps(other))
