"""Entities of a single text get a verdict on the terms beside them."""

from pyspark.sql import functions as F

from tabprep.llm import personal


def test_a_term_beside_an_entity_of_one_text_is_generalised(spark):
    docs = [(i, f"the mail about day {i} said nothing new") for i in range(400)]
    docs += [(1000, "the mail of kestrelwing from ann@corp.example.com said nothing"), (1001, "call +44 20 7946 0958 now")]
    got = {r.doc_id: r for r in personal.find_personal(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [s.split(":")[0] for s in got[1000].spans if s.startswith("term:")][:1] == ["term"]
    assert "kestrelwing" not in got[1000].sanitised and "<word>" in got[1000].sanitised
    assert "the mail" in got[1000].sanitised and "said nothing" in got[1000].sanitised
    assert got[0].spans == []


def test_little_evidence_discloses_less_than_much(spark):
    docs = [(i, f"plain text number {i % 7} here") for i in range(500)]
    docs += [(1000 + i, f"plain text often{"" if i else " once"} bob@corp.example.com") for i in range(6)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tkey", F.md5(F.concat("text", F.col("doc_id").cast("string"))))
    terms = {r.term: r.disclosure for r in personal.disclosure(d)[0].collect()}
    assert terms["often"] > terms.get("once", 0.0)


def test_texts_without_terms_are_not_shuffled_to_them(spark, monkeypatch):
    docs = [(i, f"the mail about day {i} said nothing new") for i in range(400)]
    docs += [(1000 + i, f"the mail of kestrel{i} from ann{i}@corp.example.com said nothing") for i in range(40)]
    docs += [(2000 + i, "the mail of kestrel1 was copied") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    near = sorted(map(tuple, personal.find_personal(df).collect()))
    monkeypatch.setattr(personal, "SIDE_BYTES", 0)
    sent, plain = [], personal.split_by

    def split(rows, side, n, key):
        may, rest = plain(rows, side, n, key)
        sent.append((key, may.count(), rows.count(), rest.count()))
        return may, rest
    monkeypatch.setattr(personal, "split_by", split)
    assert sorted(map(tuple, personal.find_personal(df).collect())) == near
    assert [k for k, *_ in sent] == ["tkey", "term", "tkey"]  # copies, terms in the texts, texts with terms
    assert all(may + rest == rows and may < rows / 3 for _, may, rows, rest in sent)
    assert sum(any(s.startswith("term") for s in r[1]) for r in near) == 70
