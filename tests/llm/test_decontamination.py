"""Verbatim matches with benchmark items against brute force, and their edges."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.llm import decontamination


def brute(text, items, window):
    words = decontamination.words_of((text or "").encode())
    hit, found, begins, longest = set(), set(), set(), 0
    for name, item in items:
        own = decontamination.words_of((item or "").encode())
        n = min(window, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == own[s:s + n]:
                    found.add("" if name is None else str(name))
                    hit |= set(range(p, p + n))
                    begins.add(p)
    for p in begins:
        for _, item in items:
            own = decontamination.words_of((item or "").encode())
            for s in range(len(own)):
                n = 0
                while p + n < len(words) and s + n < len(own) and words[p + n] == own[s + n]:
                    n += 1
                longest = max(longest, n)
    return len(words), hit, sorted(found), longest


def check(docs, items, texts, rows, window):
    found = decontamination.find_matches(docs, items, window=window).collect()
    assert len(found) == len(texts)
    by_id = {r.doc_id: r for r in found}
    for key, text in texts:
        row, (n_words, hit, names, longest) = by_id[key], brute(text, rows, window)
        assert (row.n_words, row.n_hit, row["items"]) == (n_words, len(hit), names)
        assert {i for s in row.spans for i in range(s.start, s.stop)} == hit
        assert (row.longest.n_words if row.longest else 0) == longest
        if row.longest:
            item = next(decontamination.words_of(t.encode()) for n, t in rows
                        if ("" if n is None else str(n)) == row.longest.item_id
                        and decontamination.words_of((t or "").encode())[row.longest.item_start:][:longest]
                        == decontamination.words_of(text.encode())[row.longest.start:][:longest])
            assert item


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(dice.choice([2, 5, 30]))]
    window = (2, 4, 10)[seed]
    items = [(i, " ".join(dice.choices(words, k=dice.randint(0, 20)))) for i in range(8)]
    texts = [(i, " ".join(dice.choices(words + ["other"], k=dice.randint(0, 60)))) for i in range(40)]
    texts += [(100 + i, f"x {t.upper()}, y-{items[i - 1][1]}") for i, t in items]
    check(spark.createDataFrame(texts, "doc_id long, text string").repartition(3),
          spark.createDataFrame(items, "item_id long, text string"), texts, items, window)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [(1, None), (2, ""), (3, " .,;! "), (4, f"A. {passage} b"), (5, passage.replace("p15", "q")),
             (6, "é-Ü one"), (7, "lorem ipsum " * 30_000 + passage), (8, "É ü"), (None, passage)]
    items = [(1, passage), (1, passage), (2, None), (3, "..."), (None, "é ü"), (5, passage[:40]), (6, "É ü")]
    docs = spark.createDataFrame([(*t, "n") for t in texts], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    check(docs, bench, texts, items, 10)
    by_id = {r.doc_id: r for r in decontamination.find_matches(docs, bench).collect()}
    # Only A to Z are lowered, so the letters beyond ASCII must be the same.
    assert not by_id[6]["items"] and by_id[8]["items"] == ["6"]
    assert by_id[7].spans[0].start == 60_000
    kept = decontamination.remove_contaminated(docs.withColumn("_contaminated", F.lit(1)), bench)
    assert kept.columns == docs.columns + ["_contaminated"]
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 6}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "a b", 1)], none.schema)
    assert decontamination.find_matches(none, some).count() == 0
    row = decontamination.find_matches(some, none).first()
    assert (row.n_words, row.n_hit, row["items"], row.longest) == (2, 0, [], None)
    assert decontamination.remove_contaminated(some, none).count() == 1


def test_several_blocks_and_shards(spark, monkeypatch):
    dice = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(dice.choices(words, k=25))) for i in range(30)]
    texts = [(i, " ".join(dice.choices(words, k=30) + items[dice.randrange(30)][1].split()[:dice.randint(5, 25)]))
             for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontamination.find_matches(docs, bench).select("doc_id", "n_hit", "items").collect())
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 500)
    assert sorted(decontamination.find_matches(docs, bench).select("doc_id", "n_hit", "items").collect()) == whole
    check(docs, bench, texts, items, 10)
    assert any(r.n_hit for r in whole)


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = decontamination.find_matches(docs, docs.withColumnRenamed("doc_id", "item_id"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
