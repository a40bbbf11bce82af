"""Pages on subdomains of listed names are blocked."""

from tabprep.llm import queries as q


def test_a_listed_name_is_a_whole_label_of_the_host(spark, tmp_path):
    urls = ["http://blog.adult-x.example.net/a", "https://WWW.Adult-X.example.net/b", "http://a.b.spam-farm.example.net/",
            "http://not-adult-x.example.net/", "http://adult-xy.example.net/", "http://x.example.net/blog.adult-x.net",
            "http://x.example.net?u=.adult-x.net"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.verdict for r in q.QUERIES["op9_urlfilter"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(7)] == ["block"] * 3 + ["allow"] * 4
