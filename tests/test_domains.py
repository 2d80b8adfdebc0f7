import pytest
from pyspark.sql import functions as F

from presswork.functions import suffixes
from presswork.functions.suffixes import (
    public_rules, rules_from_text, suffix_frame, suffix_table)
from presswork.functions.urls import host, registered_domain
from presswork.operators import domains

CASES = [
    ("http://a.b.co.uk/x?y#z", "a.b.co.uk", "b.co.uk"),
    ("https://www.example.com", "www.example.com", "example.com"),
    ("example.com/path", "example.com", "example.com"),
    ("//cdn.example.org/x", "cdn.example.org", "example.org"),
    ("ftp://user:pass@files.example.net:21/x", "files.example.net", "example.net"),
    ("http://u@h@deep.example.com/", "deep.example.com", "example.com"),
    ("HTTP://WWW.Example.COM/", "WWW.Example.COM", "Example.COM"),
    ("http://my_host.example.com/a b", "my_host.example.com", "example.com"),
    ("http://127.0.0.1/", "127.0.0.1", ""),
    ("http://[::1]:80/", "[", ""),
    ("localhost:80", "localhost", ""),
    ("http://co.uk/", "co.uk", ""),
    ("http://.com/", ".com", ""),
    ("http://example.com./", "example.com", "example.com"),
    ("http://example。com/", "example.com", "example.com"),
    ("http://a.b.unknownsuffix/", "a.b.unknownsuffix", ""),
    ("http://x.y.z.ck/", "x.y.z.ck", "y.z.ck"),
    ("http://z.ck/", "z.ck", ""),
    ("http://a.www.ck/", "a.www.ck", "www.ck"),
    ("http://x.city.kawasaki.jp/", "x.city.kawasaki.jp", "city.kawasaki.jp"),
    ("http://x.y.other.kawasaki.jp/", "x.y.other.kawasaki.jp", "y.other.kawasaki.jp"),
    ("https://news.site.com.ar/", "news.site.com.ar", "site.com.ar"),
    ("https://x.dept.gov.au/", "x.dept.gov.au", "dept.gov.au"),
    ("https://foo.museum/", "foo.museum", "foo.museum"),
    ("https://u.github.io/", "u.github.io", "github.io"),
    ("https://a.b.xn--mgba3a4f16a/", "a.b.xn--mgba3a4f16a", "b.xn--mgba3a4f16a"),
    ("", "", ""),
    ("://x", "", ""),
    (None, None, None),
]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, url string")


def result(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_hosts(urls):
    assert result(urls.withColumn("h", host(F.col("url"))), "h") == [c[1] for c in CASES]


def test_built_in_rules(urls):
    assert result(domains.with_domain(urls), "domain") == [c[2] for c in CASES]


def test_suffix_table(spark, urls):
    df = domains.with_domain(urls, suffix_frame(spark, public_rules()))
    assert result(df, "domain") == [c[2] for c in CASES]
    assert df.columns == ["i", "url", "domain"]


def test_too_many_rules_are_refused(spark, urls, monkeypatch):
    monkeypatch.setattr(suffixes, "MAX_RULES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        rules_from_text("a b c")
    with pytest.raises(ValueError, match="more than 2"):
        domains.with_domain(urls, spark.createDataFrame(
            [(s, False, False) for s in "abc"], "suffix string, is_wildcard boolean, is_exception boolean"))


def test_private_rules_only_if_asked_for(spark, urls):
    private = domains.with_domain(urls, public_rules(private=True))
    assert "u.github.io" in result(private, "domain")


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// a comment\ncom\n\n*.zz\n!ok.zz\nایران\n")
    table = {tuple(r) for r in suffix_table(spark, str(path)).collect()}
    assert table == {("com", False, False), ("zz", True, False), ("ok.zz", False, True),
                     ("ایران", False, False), ("xn--mgba3a4f16a", False, False)}
    rules = rules_from_text(path.read_text())
    assert rules.wildcard == {"zz"} and rules.exception == {"ok.zz"}
    assert {"ایران", "xn--mgba3a4f16a"} <= rules.exact
    df = spark.createDataFrame(
        [("http://a.b.xn--mgba3a4f16a/",), ("http://a.q.zz",), ("http://a.ok.zz",)], "url string")
    found = [r[0] for r in df.select(registered_domain(F.col("url"), rules)).collect()]
    assert found == ["b.xn--mgba3a4f16a", "a.q.zz", "ok.zz"]


def test_empty_suffix_table(spark, urls):
    df = domains.with_domain(urls, suffix_frame(spark, rules_from_text("")))
    assert result(df, "domain") == [None if c[0] is None else "" for c in CASES]
