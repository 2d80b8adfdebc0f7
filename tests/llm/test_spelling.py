"""Spelling variants against brute force, and their edges."""

import collections
import random
import re
import zlib

import pytest

from presswork.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    rows = {}
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] < 2 * n:
            best = None
        rows[word] = (best, n, len(others))
    out = set()
    for word, (form, n, n_near) in rows.items():
        root = word
        while rows[root][0] is not None:
            root = rows[root][0]
        out.add((word, form, root, n, n_near, None if form is None else counts[form]))
    return out


def variants(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = [tuple(r) for r in spelling.spelling_variants(frame).collect()]
    assert len(rows) == len(set(rows)) == len(counts)
    return set(rows)


@pytest.mark.parametrize("seed, letters, longest", [(1, "ab", 7), (2, "abcé😀", 5), (3, "aabx", 9)])
def test_brute_force(spark, seed, letters, longest):
    dice = random.Random(seed)
    words = {"".join(dice.choices(letters, k=dice.randint(1, longest))) for _ in range(150)}
    counts = {w: dice.choice([1, 2, 3, 4, 8, 16, 40]) for w in words}
    assert variants(spark, counts) == brute(counts)


def test_long_and_repeated_letters(spark):
    base = "".join(random.Random(4).choices("abc", k=60))
    counts = {base: 50, base[:40] + "z" + base[40:]: 20, base[:30] + base[31:]: 3, base[:-1]: 9, base[1:]: 2,
              "a" * 3000: 5, "a" * 3001: 11, "a" * 3002: 1, "a" * 1500 + "b" + "a" * 1499: 2, "": 7, "q": 3}
    assert variants(spark, counts) == brute(counts)


def test_a_letter_everywhere(spark):
    """Words that all differ in one place meet in one group; every word has many neighbours."""
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xDF, 0x100)]
    counts = {f"wor{c}d": i + 1 for i, c in enumerate(letters)} | {"word": 500, "words": 2000}
    assert variants(spark, counts) == brute(counts)


def test_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(none).count() == 0
    lone = spark.createDataFrame([(None, 5), ("alone", 2)], "word string, n long")
    assert [tuple(r) for r in spelling.spelling_variants(lone).collect()] == [("alone", None, "alone", 2, 0, None)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(none, ratio=1)
    twice = spark.createDataFrame([("colour", 2, "x"), ("colour", 3, "y"), ("color", 10, "z")], "word string, n int, root string")
    assert {tuple(r) for r in spelling.spelling_variants(twice).collect()} == {
        ("colour", "color", "color", 5, 1, 10), ("color", None, "color", 10, 1, None)}


def test_counts(spark):
    dice = random.Random(6)
    words = ["".join(dice.choices("abcdeéÀÖ", k=dice.randint(3, 9))) for _ in range(60)]
    docs = [(i, " 1,".join(dice.choices(words, k=200)).title(), i) for i in range(30)]
    docs += [(None, "hello Hello-hello", 0), (4, None, 0), (5, "", 0), (6, "x" * 100_000 + " ok" * 4, 0), (6, "again " * 3, 1)]
    counts = collections.Counter()
    for key, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    wanted = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    frame = spark.createDataFrame(docs, "doc_id long, text string, n long")
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == wanted
    assert "again" in wanted and spelling.count_words(frame.limit(0)).count() == 0
