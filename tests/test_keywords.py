import random

import pytest
from pyspark.sql import functions as F

from html_reference import html_text
from presswork.operators.keywords import DEFAULT_PAIRS, keyword_pairs, match_keywords

PAGES = [
    (1, "<p>The cat and the dog. THE end</p>"),
    (2, "no hits here"),
    (3, None),
    (4, ""),
    (5, "aaaa A.B axb <script>the the the</script>"),
    (6, "Ünder ünder der"),
]


def brute_force(pairs):
    out = {}
    for key, html in PAGES:
        if html is not None:
            text = " ".join(html_text(html).split()).lower()
            met = [k for k, w in pairs if text.count(k.lower()) >= w]
            if met:
                out[key] = met
    return out


@pytest.mark.parametrize("pairs", [
    [("the", 3)], [("the", 4)], [("The", 2), ("dog", 1), ("The", 2)], [("aa", 2), ("a.b", 1)],
    [("", 1)], [("", 20)], [("zzz", 0)], [("zzz", 0)] * 40, [("ÜNDER", 2), ("der", 3)], [("é", 1)],
    [(w, 1 + i % 3) for i, w in enumerate(["the", "a", "der", "", "aa", "x", "nd"] * 6)],
])
def test_match(spark, pairs):
    df = spark.createDataFrame(PAGES, "id int, content string")
    rows = match_keywords(df, pairs).collect()
    assert {r.id: r.matched_keywords for r in rows} == brute_force(pairs)


def test_no_pairs_match_nothing(spark):
    df = spark.createDataFrame(PAGES, "id int, content string")
    assert match_keywords(df, []).count() == 0


def test_pair_limits():
    assert keyword_pairs() == list(DEFAULT_PAIRS)
    assert keyword_pairs([("a", 10)] * 10)
    for wrong in ([], [("a", 1)] * 11, [("a", 0)], [("a", 11)]):
        with pytest.raises(ValueError):
            keyword_pairs(wrong)


def test_other_filters_pass_the_text(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame(PAGES, "id int, content string").write.parquet(path)
    df = match_keywords(spark.read.parquet(path), [("the", 1), ("a", 1)]).where(F.col("id") > 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan
    assert plan.count("!--.*?-->") == 1


@pytest.mark.parametrize("seed, letters, pairs", [(1, "ab", 30), (2, "abc.*[]^-&\\ ", 80), (3, "éß😀x", 20), (4, "abcdefgh", 500)])
def test_many_keywords_that_begin_or_overlap_each_other(spark, seed, letters, pairs):
    dice = random.Random(seed)
    texts = [(i, "".join(dice.choices(letters + "  ", k=dice.choice([0, 10, 200])))) for i in range(60)]
    wanted = [("".join(dice.choices(letters, k=dice.randint(1, 5))), dice.randint(1, 6)) for _ in range(pairs)]
    wanted += [("aa", 2), ("aba", 3), ("a\nb", 1), ("\\E", 1), (" ", 4)]
    rows = match_keywords(spark.createDataFrame(texts, "id int, content string"), wanted).collect()
    expected = {}
    for key, text in texts:
        text = " ".join(text.split()).lower()
        met = [k for k, w in wanted if text.count(k.lower()) >= w]
        if met:
            expected[key] = met
    assert {r.id: r.matched_keywords for r in rows} == expected


def test_the_text_is_searched_once(spark):
    df = spark.createDataFrame(PAGES, "id int, content string")
    few, many = ([(f"w{i}", 1) for i in range(n)] for n in (2, 60))
    for pairs in (few, many):
        plan = match_keywords(df, pairs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("(?=[w])") == 1
