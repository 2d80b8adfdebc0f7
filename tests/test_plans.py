"""What the plans of the queries must and must not contain."""

import datetime as dt

import pytest

from presswork.operators import filters
from presswork.plans.listing import ListRequest, article_details, article_list
from presswork.plans.queries import QUERIES
from presswork.schema import CONTENT

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_products(name, spark):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert word not in text
    if name != "url_new_any_case":
        # Collated keys cannot be hashed; all else aggregates without sorting.
        assert "SortAggregate" not in text


def test_list_page_cleans_text_once(spark):
    assert plan(QUERIES["news_list"](spark, SF_DIR)).count("!--.*?-->") == 1


@pytest.mark.parametrize("name, exchanges", [
    ("keyword_match", 0), ("html_clean_text", 0), ("html_blocks", 0), ("registered_domain", 0),
    ("title_search_bag", 0), ("source_counts_last_week", 2), ("daily_counts", 2),
])
def test_shuffles(name, exchanges, spark):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("- Exchange ") == exchanges


def test_counts_read_two_columns(spark):
    text = plan(QUERIES["source_counts_last_week"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def rows_of(spark, rows):
    names = CONTENT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CONTENT)


def test_list_request(spark):
    when = dt.datetime(2024, 1, 3)
    rows = [
        dict(id=1, title="Alpha", title_persian="alpha p", date=when, content="<b>gold</b> gold",
             url="http://a.example.com/", source="s", summary="S" * 300, views=3, type="News"),
        dict(id=2, title="alpha", date=when, content="gold", url=None, source="s", type="News",
             summary_persian="خلاصه"),
        dict(id=3, title="beta", date=when, content="gold gold", source="s", type="News"),
        dict(id=4, title="alpha", date=None, content="gold gold", source="s", type="News"),
    ]
    content = rows_of(spark, rows)
    request = ListRequest(pairs=[("GOLD", 2), ("x", 1)], title="alpha", sources=[filters.ALL],
                          start="2024-01-01", end="2024-01-09", kind=filters.ALL,
                          domain=filters.ALL, sort_by="source", ascending=True)
    cards = article_list(content, request).collect()
    assert [(c.id, c.title, c.domain, c.keywords) for c in cards] == [
        (1, "alpha p", "example.com", "GOLD")] * 2
    assert cards[0].summary == "S" * 200 + "..."
    default = article_list(content, ListRequest(sort_by="date")).collect()
    assert [(c.id, c.keywords) for c in default] == [(1, ""), (2, ""), (3, ""), (4, "")]
    assert default[1].summary == "خلاصه..." and default[1].domain is None


def test_details(spark):
    content = rows_of(spark, [
        dict(id=1, title="t", title_persian="", content="", content_persian="cp", summary="s"),
        dict(id=2, title="t", title_persian="p", content="c", summary_persian="sp")])
    one = article_details(content, 1).collect()
    assert [(r.title, r.content, r.summary, r.title_api, r.summary_api) for r in one] == [
        ("t", "cp", "s", "", "s")]
    english = {r.id: (r.title, r.content) for r in
               article_details(content, second_language=False).collect()}
    assert english == {1: ("t", ""), 2: ("t", "c")}
    assert article_details(content, 9).count() == 0


@pytest.mark.parametrize("name, pattern, most", [
    ("generated_articles", "get_json_object", 1), ("translation_updates", "get_json_object", 1),
    ("image_urls", "try_parse_json|parse_json", 1), ("news_list_site", "_suffix1#[0-9]+ =", 1)])
def test_costly_values_are_worked_out_once(name, pattern, most, spark):
    import re
    text = plan(QUERIES[name](spark, SF_DIR))
    assert len(re.findall(pattern, text)) <= most


def test_list_request_keeps_the_limits_of_the_form(spark):
    with pytest.raises(ValueError, match="keywords"):
        article_list(rows_of(spark, []), ListRequest(pairs=[("a", 1)] * 11))
