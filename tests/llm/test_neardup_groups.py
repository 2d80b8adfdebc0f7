"""Near duplicates in large groups around the threshold, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.llm import neardup


def components(texts):
    """The least id of each text's component, by comparing all pairs."""
    sets = {}
    for key, text in texts:
        words = text.encode().lower().split()
        sets[key] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}
    root = {key: key for key in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                one, other = sorted((find(a), find(b)))
                root[other] = one
    return {key: find(key) for key in keys}


def near_copies(seed, members, words, changed):
    """Copies of one text of so many words, each with a number of words changed."""
    dice = random.Random(seed)
    base = [f"w{dice.randrange(10 ** 6)}" for _ in range(words)]
    texts = []
    for i in range(members):
        copy = list(base)
        for at in dice.sample(range(words), dice.choice(changed)):
            copy[at] = f"x{dice.randrange(10 ** 6)}"
        texts.append((i, " ".join(copy)))
    return texts


@pytest.mark.parametrize("words, changed, block", [(60, [2], 1024), (120, range(0, 9), 64), (60, [1, 2, 3], 32)])
def test_group_around_the_threshold(spark, monkeypatch, words, changed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_copies(words, 300, words, changed) + [(1000 + i, f"lone text number {i} with words") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == components(texts)


def test_blocks_are_bounded_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    texts = near_copies(5, 80, 200, range(2, 14))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == components(texts)


def test_rows_handed_on_grow_with_the_members(spark):
    """No pair of a group leaves its block: two words changed in 60 make all pairs promising and none a link."""
    made = {}
    for members in (200, 800):
        docs = spark.createDataFrame(near_copies(7, members, 60, [2]), "doc_id long, text string")
        rows = neardup.sketches(docs).cache()
        classes = rows.select("set_id", "n_shingles", "registers", "filled")
        banded = neardup._explode_bands(classes)
        met = banded.join(banded.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1"), "band")
        sets = neardup._shingle_sets(docs)
        alone = spark.createDataFrame([], "id binary, label binary")
        links = neardup._block_links(met.drop("rows"), alone, classes, sets)
        made[members] = links.count()
    assert all(n <= 2 * members for members, n in made.items())


def test_any_character_stands_in_a_word(spark):
    texts = [(1, "a\0b c"), (2, "a b\0c"), (3, "a\0b  C"), (4, "a"), (5, "a a"), (6, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4}
