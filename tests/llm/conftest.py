import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, spark  # noqa: F401 - the session fixture

#: Names that the operators use inside; documents may have columns of these names.
CLASHES = ["tkey", "w", "n", "pos", "key", "start", "len", "wid", "row", "word", "part", "bucket", "rid", "sig", "code",
           "hash", "owner", "repo", "base", "letters", "seed", "ids", "rank", "canon", "host", "_hit", "terms", "_gone"]


def edge_rows():
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    return [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, "   \n\t ", None, None), (4, "a", "en", "s1"),
            (5, word, "en", "s2"), (5, word, "en", "s2"), (6, word, "de", "s3"), (7, "#*$ |<> 12 34", None, "s1"),
            (8, (word + " ") * 3000, "en", "s1"), (9, "é ü ▁ 漢字 \U0001f600 ÀB", "fr", "s1"),
            (None, "alpha beta", "en", None), (10, "x" * 5000, "en", "s1")]


@pytest.fixture(scope="session")
def edge(spark):  # noqa: F811
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHES}).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs001(spark):  # noqa: F811
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def texts001(docs001):
    return [(r.doc_id, r.text) for r in docs001.select("doc_id", "text").collect()]
