import pytest

from sparkloom.llm import queries, url_filter
from sparkloom.llm.url_filter import TermCounter, Vocabulary, split_url


@pytest.mark.parametrize(("url", "want"), [
    ("http://WWW.Example.com/En/?q", ("www.example.com", "/En/")), ("x://h#f/", ("h", "")), ("a?b://h/p#x", ("h", "/p")), ("://", ("", "")), (None, ("", "")), ("h/p", ("", "")),
    ("http://u:p@h:80/É", ("u:p@h:80", "/É")), ("http://ÉA/x", ("Éa", "/x")), ("http://h?x/y", ("h", "")),
])
def test_split(url, want):
    assert split_url(url) == want


def judged(spark, urls, **how):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in url_filter.filter_urls(df, queries.URL_RULES, keep=("page_id",), **how).collect()}


def test_rules(spark):
    urls = ["http://a.com/x", "http://com/", "http://example.com/en/1", "http://m.example.com/en/1", "http://a.www.example.com/en/", "http://x.net/es/casino", "http://net/fr/", "http://xcom/",
            "http://a.com", "http://a.com/porn", "http://fooexample.com/en/"]
    rows = judged(spark, urls)
    assert [rows[i].rule for i in range(len(urls))] == ["com/", "com/", "example.com/en/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, "com/", "com/"]
    assert [rows[i].verdict for i in range(len(urls))] == ["allow", "allow", "block", "block", "allow", "block", "block", "allow", "allow", "allow", "allow"]


def test_terms(spark):
    counter = TermCounter(Vocabulary(strict=("bad", "ad"), soft=("one", "two")))
    assert counter.count("bad-ad.xad.adx BAD/bad") == (2, 0)
    assert counter.count("one_one two twone 1two") == (0, 2)
    assert counter.count("") == (0, 0)
    rows = judged(spark, ["http://q.org/porn", "http://q.org/poker", "http://q.org/poker-poker", "http://q.org/poker?bet", "http://q.org/sporn"])
    assert [rows[i].verdict for i in range(5)] == ["block", "allow", "allow", "block", "allow"]


def test_odd_urls(spark):
    rows = judged(spark, [None, "", "http://", "http://h/" + "a" * 100_000 + "/porn"])
    assert [rows[i].verdict for i in range(4)] == ["allow", "allow", "allow", "block"]
    assert url_filter.filter_urls(spark.createDataFrame([], "url string")).count() == 0
