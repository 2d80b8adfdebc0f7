import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from html_reference import html_text
from presswork.functions import text as X

DOCUMENTS = [
    "", "   ", "<b></b>", "plain", "a &amp; b", "a &amp;lt; b", "end &amp;", "cut &amp", "cut &am",
    "x &foo; y", "x &foo y", "&copy2020 x", "AT&T rocks", "a&amp</b>c", "a&amp.b c",
    "&#150;&#8364;&#x20ac;&#65 &#x110000; &#99999999999999999999;q", "&nbsp;q&nbsp;&NotEqualTilde;",
    "a<3 b", "a < b", "a</ foo>b", "a</>b", "a<br/>c", "a<b/>c", "open <b", 'open <b class="x',
    '<a title="x>y">t</a>', "<p class=it's>x</p> it's y > z",
    '<script>var t="</p>";</script>z', "<script>never closed", "<SCRIPT >x</script\n>y",
    "<style>a{}</style>b", "<template><p>x</p></template>y", "<script-x>q</script-x>",
    "a<!-- b > c -->d", "<!-- never closed", "a<![CDATA[ q<b>z ]]>c", "a<?php echo 1 ?>b",
    "<!DOCTYPE html>q", "<!foo>b", "<![if IE]>b<![endif]>",
    "<ruby>a<rt>b</rt></ruby>c", "<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>c",
    "\xa0x\x1cy \n z　", "a b  \t c", "<p>a</p>\n\n<p>b</p>",
]


def test_html_text_equals_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(DOCUMENTS)), "i int, html string")
    rows = df.select("html", X.html_text(F.col("html")).alias("text"),
                     X.clean_html(F.col("html")).alias("line")).collect()
    for row in rows:
        expected = html_text(row.html)
        assert row.text == expected, row.html
        assert row.line == re.sub(r"\s+", " ", expected).strip(), row.html


def test_html_text_on_the_pages(spark):
    for table, column in (("pages", "html"), ("documents", "text")):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        for row in df.select(column, X.html_text(F.col(column)).alias("out")).collect():
            assert row.out == html_text(row[0])


def test_long_tags_do_not_overflow_the_stack(spark):
    html = "<a " + "x='1' y=2 " * 50_000 + ">t</a><!--" + "-" * 100_000 + "-->"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(X.html_text(F.col("html"))).first()[0] == "t"


def test_null_html_stays_null(spark):
    df = spark.createDataFrame([(None,)], "html string")
    assert df.select(X.clean_html(F.col("html"))).first()[0] is None


@pytest.mark.parametrize("text, keyword, expected", [
    ("aaaa", "aa", 2), ("abc", "", 4), ("", "", 1), ("a.b axb a.b", "a.b", 2), ("", "x", 0),
    ("é é", "é", 2), ("سلام سلام", "سلام", 2), ("😀😀😀", "😀", 3), ("ab", "abc", 0),
])
def test_occurrences(spark, text, keyword, expected):
    assert text.count(keyword) == expected
    df = spark.createDataFrame([(text, keyword)], "t string, k string")
    row = df.select(X.occurrences(F.col("t"), keyword), X.occurrences(F.col("t"), F.col("k"))).first()
    assert tuple(row) == (expected, expected)


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\x1c\x85\xa0 é", max_size=12), min_size=1, max_size=40))
def test_whitespace_like_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("t", X.strip(F.col("t")).alias("s"),
                     X.collapse_whitespace(F.col("t")).alias("c"),
                     X.occurrences(F.col("t"), "ab").alias("n")).collect()
    for row in rows:
        assert row.s == row.t.strip()
        assert row.c == re.sub(r"\s+", " ", row.t).strip()
        assert row.n == row.t.count("ab")


def test_matches(spark):
    df = spark.createDataFrame([("Größe ÉTÉ",), ("a+b",), (None,)], "t string")

    def found(pattern, **kw):
        return [r[0] for r in df.select(X.matches(F.col("t"), pattern, **kw)).collect()]

    assert found("été") == [True, False, False]
    assert found("gröSSE|GRÖßE") == [True, False, False]
    assert found("a+b") == [False, False, False]
    assert found("a+b", literal=True) == [False, True, False]
    assert found("") == [True, True, False]
    with pytest.raises(Exception):
        found("(")


def test_small_functions(spark):
    df = spark.createDataFrame(
        [("x" * 300, "", "second", "a,,b , "), (None, None, None, ""), ("é" * 3, "f", None, "one")],
        "long string, first string, second string, list string")
    rows = df.select(
        X.preview(F.col("long")).alias("preview"),
        X.first_filled(F.col("first"), F.col("second")).alias("chosen"),
        X.filled(F.col("first")).alias("filled"),
        X.split_list(F.col("list")).alias("entries"),
        X.split_list(F.col("list"), keep_empty=True).alias("all_entries"),
        X.join_list(X.split_list(F.col("list"))).alias("joined"),
        X.utf16_units(F.concat(F.col("list"), F.lit("😀"))).alias("units"),
    ).collect()
    assert rows[0].preview == "x" * 200 + "..." and rows[1].preview == "..."
    assert [r.chosen for r in rows] == ["second", None, "f"]
    assert [r.filled for r in rows] == [False, False, True]
    assert rows[0].entries == ["a", "b"] and rows[0].all_entries == ["a", "", "b", ""]
    assert rows[1].entries == [] and rows[1].all_entries == [""]
    assert [r.joined for r in rows] == ["a, b", "", "one"]
    assert rows[1].units == 2
