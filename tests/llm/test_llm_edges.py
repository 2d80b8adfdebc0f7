"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import gc
import random
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from presswork.llm import (
    balltree, bpe, components, edits, materialise, mixing, neardup, pii, quality, samples, sharding,
    toxicity, workers)
from presswork.llm.memory import Memory

LONG = "lorem ipsum " * 20_000
WORDS = [f"w{i}x" for i in range(300)]
DOCS = [
    (1, "a b c d e f g h", "s", "x"), (1, "a b c d e f g h", "s", "x"), (2, None, "s", "x"), (3, "", None, "x"),
    (None, "A b C d e f g h", None, None), (4, LONG, "t", "x"), (5, "x" * 50_000, "t", "x"), (6, " \n\t ", "t", None),
    (7, "one two", "s", "x"), (8, "One  TWO", "s", "x")]
#: Columns that the operators also use as names of their own.
SCHEMA = "doc_id long, text string, source string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.share(spark, public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_edges(docs, none, vocabulary, tokenizer):
    clashing = docs.withColumnRenamed("shard", "ids")
    rows = bpe.encode(clashing, vocabulary, decoded="decoded").collect()
    assert len(rows) == len(DOCS)
    for row in rows:
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, vocabulary).count() == 0
    again = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in rows)


def test_bpe_all_of_unicode(vocabulary, tokenizer):
    own = bpe.Encoder(vocabulary.value)
    points = [*range(1, 0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1C80, 0x1C90),
              *range(0x10500, 0x11500), *range(0x16D00, 0x17000), *range(0x1E500, 0x1E700)]
    for point in points:
        if not 0xD800 <= point < 0xE000:
            for text in (f"a{chr(point)}B", f"{chr(point)} Σς{chr(point)}"):
                ids = np.frombuffer(own.encode(text), np.int32).tolist()
                assert ids == tokenizer.encode(text, add_special_tokens=False).ids, hex(point)
    for text in ("it's <|startoftext|>we'LL<|endoftext|>", "ab" * 5000, "<|EndOfText|>", "\x1c a\x1fb"):
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_many_texts_at_once(vocabulary, tokenizer, monkeypatch):
    dice = random.Random(8)
    parts = ["a", "b", "E", "é", "Σ", "İ", "中", "1", ".", ",", "'s", "'", "-", "\x1c", "\x85", " ", " ", "\n", "<",
             "<|endoftext|>", "th", "ing", "\ua7db", "\u1c89", "e\u0301", "x" * 40, "longword" * 9]
    texts = ["".join(dice.choices(parts, k=dice.randint(0, 40))) for _ in range(2000)] + [None, ""]
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    one_by_one = []
    merge = bpe.Encoder.merge
    monkeypatch.setattr(bpe.Encoder, "merge", lambda self, word: one_by_one.append(word) or merge(self, word))
    monkeypatch.setattr(bpe, "GROUP_CHARACTERS", 4000)
    for limit in (1 << 20, 500):
        own = bpe.Encoder(vocabulary.value)
        own.words.limit = limit
        found = [np.frombuffer(raw, np.int32).tolist() for raw in own.encode_all(iter(texts))]
        assert found == expected
    # Without special tokens only words beyond a block's bytes go one by one.
    one_by_one.clear()
    list(bpe.Encoder(vocabulary.value).encode_all(t for t in texts if "<|endoftext|>" not in (t or "")))
    assert all(len(w.encode()) > bpe.BLOCK_BYTES for w in one_by_one)


def test_texts_of_the_first_plane_are_cut_by_plain_classes(vocabulary, tokenizer):
    own = bpe.Encoder(vocabulary.value)
    text = "L'été Σς 中文١٢ ½Ⅷ _'s\x1c\x85a\u200b\u3000e\u0301'll"
    expected = [tokenizer.encode(text + end, add_special_tokens=False).ids for end in ("", "\u1c89", "𝒜")]
    assert [np.frombuffer(own.encode(text + end), np.int32).tolist() for end in ("", "\u1c89", "𝒜")] == expected
    own = bpe.Encoder(vocabulary.value)
    # The slower engine is for other texts only.
    own.pretokens = None
    assert np.frombuffer(own.encode(text), np.int32).tolist() == expected[0]
    assert own.ascii_pretokens.pattern.startswith("[A-Za-z]+|'s")
    assert bpe._letters_first(r"a|'s|[\p{L}]+") == r"a|'s|[\p{L}]+"


def test_words_of_many_texts_are_looked_up_once():
    made = []

    def make_all(words):
        made.append(sorted(words))
        return [w.encode() for w in words]
    words = Memory(str.encode, limit=1)
    assert list(words.lists([["a", "b", "a"], [], ["b", "c"]], make_all)) == [[b"a", b"b", b"a"], [], [b"b", b"c"]]
    assert list(words.lists([["d"]], make_all)) == [[b"d"]]
    # Words of the older generation are kept, not made again.
    assert list(words.lists([["d", "e"]], make_all)) == [[b"d", b"e"]]
    assert made == [["a", "b", "c"], ["d"], ["e"]]


def test_encoders_do_not_outlive_their_step_in_the_workers(spark, docs, vocabulary):
    def held(batches):
        from presswork.llm import workers as here
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(here.HELD)])], names=["n"])
    bpe.encode(docs, vocabulary).write.format("noop").mode("overwrite").save()
    assert {r.n for r in workers.map_batches(spark.range(0, 8, 1, 4), held, "n long").collect()} == {0}


def test_an_encoder_that_is_let_go_is_freed_at_once(vocabulary):
    gc.disable()
    try:
        own = weakref.ref(bpe.encoder(vocabulary))
        own().plain("some words")
        workers.let_go()
        assert own() is None
    finally:
        gc.enable()


def test_quality_edges(docs, none):
    clashing = docs.withColumnRenamed("shard", "n_words")
    rows = {(r.doc_id, r.n_words) for r in quality.text_statistics(clashing).collect()}
    assert rows == {(1, 8), (2, 0), (3, 0), (None, 8), (4, 40_000), (5, 1), (6, 0), (7, 2), (8, 2)}
    assert quality.text_statistics(none).count() == 0
    sample = quality.text_statistics(none.select(F.lit(1).alias("label"), "text"))
    assert quality.learn_rules(sample) == []


def test_rules_find_a_conjunction(spark):
    dice = random.Random(3)
    rows = []
    for i in range(600):
        symbols, lines = dice.random() < 0.5, dice.random() < 0.5
        words = [w + dice.choice("#$") * symbols for w in dice.sample(WORDS, 80)]
        text = ("\n" if lines else " ").join(words)
        rows.append((0 if symbols and lines else 1, text))
    sample = quality.text_statistics(spark.createDataFrame(rows, "label int, text string"))
    rules = quality.learn_rules(sample)
    decided = sample.withColumn("rule", quality.deciding_rule(rules)).collect()
    assert all((r.rule is not None) == (r.label == 0) for r in decided)
    assert len(quality.describe(rules)) == len(rules) and " and " in quality.describe(rules)[0]


def test_sample_is_bounded(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert samples.labelled_sample(docs, labels, "toxic", max_rows=3).count() <= 4
    assert samples.labelled_sample(docs, labels, "toxic").count() == 9


def test_sample_is_bounded_with_a_repeated_id(spark):
    texts = spark.range(3000).select(
        F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    for bound in (1, 50, 1500, 2000, 2002, 9000):
        rows = samples.labelled_sample(texts, labels, "toxic", max_rows=bound).collect()
        assert len(rows) <= bound and len({r.text for r in rows}) == len(rows)
        assert sum(int(r.text[1:]) < 1000 for r in rows) <= samples.PER_KEY
        if bound == 9000:
            assert len(rows) == 2000 + samples.PER_KEY
            again = samples.labelled_sample(texts.repartition(5), labels, "toxic", max_rows=bound).collect()
            assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    ranked = samples.labelled_sample(texts, labels, "toxic")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_factorization_learns_a_pair(spark):
    dice = random.Random(5)
    rows = []
    for i in range(1200):
        words = dice.choices(WORDS, k=20)
        insult, group = dice.random() < 0.4, dice.random() < 0.4
        text = " ".join(words + ["dolt"] * insult + ["folk"] * group)
        rows.append((int(insult and group), text))
    machine = toxicity.train(spark.createDataFrame(rows, "label int, text string"))
    tests = [(1, "w1x dolt w2x folk"), (0, "w1x dolt w2x"), (0, "folk w4x"), (0, "w3x w9x"), (0, None), (0, "")]
    frame = spark.createDataFrame(tests, "score int, text string")
    scored = toxicity.score(frame.withColumn("y", F.col("score")), machine).collect()
    assert [int(r.score >= 0.3) for r in scored] == [r.y for r in scored]
    flat = toxicity.train(spark.createDataFrame([], "label int, text string"))
    assert toxicity.score(frame, flat).select("score").distinct().count() == 1


def test_mixing(docs, none, spark):
    clashing = docs.withColumnRenamed("shard", "copy_no")
    rates = mixing.repetition_rates(clashing, {"s": 2.0, "t": 0.0}, epochs=3.0)
    by_source = {r.source: r for r in rates.collect()}
    assert set(by_source) == {"s", "t", None} and by_source["t"].rate == 0
    total = sum(r.bytes for r in by_source.values())
    assert by_source["s"].rate * by_source["s"].bytes == pytest.approx(2 * total)
    rows = mixing.replicate(clashing, rates).collect()
    assert {r.source for r in rows} <= {"s", None}
    assert mixing.replicate(none, rates).count() == 0
    assert mixing.repetition_rates(none, {}).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("").alias("text"))
    for rate in (0.3, 5.0, 90.0):
        wanted = spark.createDataFrame([("a", 1, rate)], "source string, bytes long, rate double")
        counts = collections.Counter(r.doc_id for r in mixing.replicate(many, wanted).select("doc_id").collect())
        drawn = np.array([counts[i] for i in range(20_000)])
        assert drawn.mean() == pytest.approx(rate, rel=0.03) and drawn.var() == pytest.approx(rate, rel=0.06)
    order = [r.mix_key for r in mixing.replicate(many.limit(500), wanted, partitions=7).collect()]
    assert order == sorted(order)


def test_mixing_draws_for_each_row_of_an_id(spark):
    """NULL ids, one id on many texts, and equal rows: no group vanishes, repeats or sorts as one."""
    wanted = spark.createDataFrame([("a", 1, 0.5)], "source string, bytes long, rate double")
    parts = {
        "null": spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("n"), "id").alias("text")),
        "one": spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("o"), "id").alias("text")),
        "equal": spark.range(4000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("e").alias("text")),
        "own": spark.range(4000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("u"), "id").alias("text"))}
    rows = None
    for kind, part in parts.items():
        part = part.select("*", F.lit("a").alias("source"), F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.union(part)
    mixed = mixing.replicate(rows, wanted, partitions=5)
    got = mixed.collect()
    for kind in parts:
        own = [r for r in got if r.kind == kind]
        assert len(own) == pytest.approx(2000, rel=0.1)
        assert len({r.mix_key for r in own}) == len(own)
    again = mixing.replicate(rows.repartition(7), wanted, partitions=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    alone = mixing.replicate(rows.filter("kind = 'own'"), wanted, partitions=5).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in got if r.kind == "own")
    for null in (r for r in got if r.kind == "null"):
        assert null.doc_id is None and null.text.startswith("n")


def test_sharding(docs, none, spark):
    sizes = docs.select("doc_id", sharding.document_size("text").alias("size"), "shard")
    rows = sharding.shard_by_bytes(sizes, 3, ["doc_id"]).collect()
    assert len(rows) == len(DOCS)
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    even = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit(10).alias("size"))
    counts = collections.Counter(r.shard for r in sharding.shard_by_bytes(even, 7, ["doc_id"]).collect())
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.shard_by_bytes(none.select("doc_id", F.lit(1).alias("size")), 3, ["doc_id"]).count() == 0


def plain_permutation(size, key):
    """The keyed Feistel network with cycle walking, number by number."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, word = (1 << half) - 1, (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & word
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & word
        return h ^ (h >> 31)
    keys = [mix((n * 0x9E3779B97F4A7C15 + key % (1 << 64)) & word) for n in range(1, 7)]
    out = []
    for value in range(size):
        while True:
            left, right = value >> half, value & mask
            for k in keys:
                left, right = right, left ^ (mix((right + k) & word) & mask)
            value = left << half | right
            if value < size:
                break
        out.append(value)
    return out


def test_materialise(docs, none, vocabulary, tokenizer, spark, tmp_path):
    for size in (1, 2, 5, 64, 1000, 4097):
        for key in (0, 7, -3):
            slots = materialise.permute(np.arange(size), size, key).tolist()
            assert sorted(slots) == list(range(size))
            assert size > 1000 or slots == plain_permutation(size, key)
    rows = materialise.sequences(docs.coalesce(1), vocabulary, 16, 49407)
    slotted, size = materialise.assign_slots(rows, 11, rows.columns)
    written = materialise.write_shards(slotted, size, f"file://{tmp_path}", 16, 100)
    assert written.count() == size
    for start in (150, 0):
        stored = {r.slot: r.ids for r in
                  materialise.read_shards(spark, f"file://{tmp_path}", 16, 100, size, start).collect()}
        assert sorted(stored) == list(range(start, size))
    # The whole stream of the one partition, cut, and put where the permutation says.
    stream = []
    for text in (r.text for r in docs.coalesce(1).collect()):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        stream += [*ids, 49407] if ids else []
    stream += [49407] * (-len(stream) % 16)
    assert size == len(stream) // 16
    for n, slot in enumerate(plain_permutation(size, 11)):
        assert stored[slot] == stream[16 * n:16 * n + 16]
    empty = materialise.sequences(none, vocabulary, 16, 49407)
    slotted, size = materialise.assign_slots(empty, 11, empty.columns)
    assert size == 0 and materialise.write_shards(slotted, size, f"file://{tmp_path}/none", 16, 100).count() == 0
    with pytest.raises(ValueError, match="16 bits"):
        materialise.sequences(docs, vocabulary, 16, 70_000)


def test_edits(docs, none, vocabulary, tokenizer):
    dice = random.Random(2)
    own = bpe.Encoder(vocabulary.value)
    for turn in range(60):
        text = "".join(dice.choices("ab c\n<|endoftext|>é'́ ", k=dice.choice([0, 3, 900, 3000])))
        tree = edits.TokenTree(text, own)
        for _ in range(12):
            start = dice.randint(0, len(text) + 2)
            stop = start + dice.choice([0, 1, 5, 400])
            new = "".join(dice.choices("xy z\n", k=dice.choice([0, 1, 3, 700])))
            tree.edit(start, stop, new)
            text = text[:start] + new + text[max(stop, start):]
            assert tree.text == text
            assert tree.total == len(tokenizer.encode(text, add_special_tokens=False).ids)
    changed = docs.withColumn("edits", F.expr("""CASE WHEN doc_id = 1 THEN array(
        named_struct('start', 0, 'stop', cast(NULL AS int), 'text', 'hi '), NULL,
        named_struct('start', 999, 'stop', -5, 'text', cast(NULL AS string))) END"""))
    rows = edits.count_edited(changed, vocabulary).collect()
    assert len(rows) == len(DOCS)
    assert all(r.n_after == r.n_before + (r.doc_id == 1) for r in rows)
    assert edits.count_edited(none.withColumn("edits", F.expr(
        "array(named_struct('start', 0, 'stop', 0, 'text', ''))")), vocabulary).count() == 0


def brute(vectors, asked, k):
    found = []
    for own, q in vectors:
        if own in asked:
            scores = sorted((-max(min(sum(a * b for a, b in zip(q, v)), 2 ** 63 - 1), -2 ** 63), i)
                            for i, v in vectors if i != own and len(v) == len(q))
            found += [(own, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize("kind", ["spread", "equal", "large", "huge"])
def test_balltree(spark, kind):
    dice = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in dice.normal(0, 0.2, 6)]) for i in range(700)]
    if kind == "equal":
        rows = [(i, v if i % 3 else [0.5] * 6) for i, v in rows]
    if kind in ("large", "huge"):
        rows = [(i, [x * (1e5 if kind == "large" else 1e9) for x in v]) for i, v in rows[:200]]
    odd = [(9001, None), (9002, [None] + [1.0] * 5), (9003, [float("nan")] * 6), (9004, [float("inf")] * 6),
           (9010, [1.0, 2.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    vectors = frame.select("vec_id", balltree.scaled(F.col("embedding")).alias("vector"))
    got = balltree.top_inner_products(vectors, F.col("vec_id") % 10 == 0, shard_rows=150, query_rows=40)
    exact = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute(exact, {i for i, _ in rows if i % 10 == 0}, 10)
    assert balltree.top_inner_products(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 0)]
    labels = {r.id: r.label for r in
              components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_near_duplicate_edges(docs, none):
    rows = neardup.near_duplicates(docs.withColumnRenamed("shard", "kept")).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got == {(1, 4, 1, True): 2, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (None, 4, 1, False): 1,
                   (4, 2, 4, True): 1, (5, 1, 5, True): 1, (6, 0, 6, True): 1, (7, 1, 7, True): 1,
                   (8, 1, 7, False): 1}
    assert neardup.near_duplicates(none).count() == 0


def test_stage_keeps_one_row_of_each_component(spark):
    """Ids that are NULL, repeated, or stand on a unique text and on a copy of a smaller id's."""
    base = WORDS[:100]
    text, near, alone = " ".join(base), " ".join(["new", *base[1:]]), [" ".join(WORDS[n:n + 60]) for n in (110, 180, 240)]
    rows = [(None, near, "a"), (None, alone[0], "b"), (None, None, "c"), (None, "", "d"), (1, text, "e"), (1, text, "f"),
            (1, text, "f"), (2, near, "g"), (2, alone[1], "h"), (None, alone[2], "i"), (None, alone[2], "j"), (1, "", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    got = sorted(tuple(r)[2] for r in kept.collect())
    assert [x for x in got if x not in "efij"] == ["b", "c", "d", "h", "k"]
    assert len([x for x in got if x in "ef"]) == 1 == len([x for x in got if x in "ij"])
    assert corpus_pipeline.drop_near_duplicates(spark, frame.limit(0), "").count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text that mostly reach each other only through others, in blocks."""
    dice = random.Random(4)
    base = dice.choices(WORDS, k=200)
    rows = [(1000, " ".join(base))]
    for i in range(300):
        words = list(base)
        for at in dice.sample(range(200), 5):
            words[at] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(2000 + i, " ".join(dice.choices(WORDS, k=100) + base[:60])) for i in range(100)]
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                one, other = sorted((root(a), root(b)))
                parent[other] = one
    old = neardup.BLOCK
    neardup.BLOCK = 64
    try:
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        neardup.BLOCK = old
    assert {r.doc_id: r.component_id for r in found} == {i: root(i) for i in sets}


def test_pii(docs, none, spark):
    kept = pii.replace_entities(docs.withColumnRenamed("shard", "n_entities"), "k").collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter(d[:2] for d in DOCS)
    assert pii.replace_entities(none, "k").count() == 0
    text = ("Mr. John Smith wrote to Mrs. Anna Smith and Herr Иван Петров: call +1 (017) 555-7713 or "
            "+1-017-555-7713, X.Y@mail.example.org x.y@MAIL.example.org, 4111 1111 1111 1111, 10.20.30.40, "
            'token = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"')
    rows = spark.createDataFrame([(1, text), (2, text), (3, "Ms. Smith, +1 (017) 555-7714")], "doc_id long, text string")
    one, two, three = [r.text for r in pii.replace_entities(rows, "k").orderBy("doc_id").collect()]
    assert one == two
    for private in ("John", "Smith", "Anna", "Иван", "555-7713", "X.Y@", "4111", "10.20.30.40", "04DBEB"):
        assert private not in one
    import re
    shape = re.match(r"Mr\. (\w+) (\w+) wrote to Mrs\. (\w+) (\w+) and Herr ([а-яА-Я]+) ([а-яА-Я]+): call "
                     r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4}), (\S+)@(\S+) (\S+)@(\S+), "
                     r"(\d{4}) (\d{4}) (\d{4}) (\d{4}), (\d+)\.\d+\.\d+\.(\d+), token = \"([0-9A-F]{40})\"$", one)
    given, family, other, family_2, *_ = shape.groups()
    assert family == family_2 and given != other and given.endswith(("ro", "ten", "us"))
    assert other.endswith(("ra", "lia", "nna")) and three.startswith(f"Ms. {family}, +1 (")
    assert shape.groups()[6:9] == shape.groups()[9:12] and shape[13].lower() == shape[15].lower()
    digits = [int(d) for d in "".join(shape.groups()[16:20])][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert pii.replace_entities(rows, "other key").first().text != one


def test_pii_of_any_length(spark):
    """Many given names, initials, titles in a row, and names and secrets of any length."""
    import re
    long, hexes = "Q" + "uexo" * 30, "0123456789abcdef" * 40
    texts = [
        "Mrs. Smith, then Mrs. Anna Maria Smith. End", "Señora María García López, Señora López!", "Mr. J. Smith went",
        "Mr. J Smith2 and Mr. J.Smith, Mr. J.-P. O’Neil-Smith; Mr. K. Smith", "Herr Dr. Hans Peter Schmidt-Weiß. Danke",
        f"Mr. {long}, key {hexes}.", "Mr. " + " ".join(["Abc"] * 20_000) + ", end", "Mr. John Smith2", "Mr. A B", "Frau José́"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [r.text for r in pii.replace_entities(rows, "k").orderBy("doc_id").collect()]
    family = re.fullmatch(r"Mrs\. (\w+), then Mrs\. (\w+) (\w+) (\w+)\. End", out[0])
    assert family[1] == family[4] and len(set(family.groups())) == 3
    assert all(w.lower().endswith(("ra", "lia", "nna")) for w in family.groups()[1:3])
    lopez = re.fullmatch(r"Señora (\w+) (\w+) (\w+), Señora (\w+)!", out[1])
    assert lopez[3] == lopez[4] and len(set(lopez.groups())) == 3
    initial = re.fullmatch(r"Mr\. (\w+) (\w+) went", out[2])
    assert initial[2] == family[1]
    parts = re.fullmatch(r"Mr\. \w+ Smith2 and Mr\. (\w+) (\w+), Mr\. (\w+) (\w+) (\w+); Mr\. (\w+) (\w+)", out[3])
    assert parts and parts[1] == parts[3] == initial[1] != parts[6] and parts[2] == parts[7] == family[1] != parts[5]
    assert re.fullmatch(r"Herr Dr\. (\w+) (\w+) (\w+)\. Danke", out[4])
    assert re.fullmatch(r"Mr\. \w+, key [0-9a-f]{640}\.", out[5]) and hexes not in out[5] and long not in out[5]
    many = re.fullmatch(r"Mr\. ((?:\w+ )+)(\w+), end", out[6])
    assert many[1].count(" ") == 19_999 and "Abc" not in out[6]
    assert re.fullmatch(r"Mr\. \w+ Smith2", out[7]) and "John" not in out[7]
    assert out[9] != texts[9] and "Jos" not in out[9] and "\u0301" not in out[9]
    for text in out:
        assert not re.search("Anna|Maria|Mar[ií]a|García|López|Neil|Hans|Peter|Schmidt|Weiß", text)


def test_surrogates_stay_distinct(spark):
    """Ten thousand family names share a space in which many first choices collide."""
    names = spark.range(10_000).select(F.lit("family.latin").alias("kind"), F.concat(F.lit("n"), "id").alias("canon"))
    assigned = pii.assign_surrogates(names, "k")
    assert assigned.count() == 10_000 == assigned.select("surrogate").distinct().count()
    few = spark.range(200).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 3, "0").alias("canon"))
    crowded = pii.assign_surrogates(few, "k")
    assert crowded.select("surrogate").distinct().count() == 200
    assert crowded.join(few.select(F.col("canon").alias("surrogate")), "surrogate").count() == 0


def test_surrogates_never_run_out(spark):
    """More entities than there are short mailboxes, names, social numbers or network addresses to choose from."""
    texts = [f"{c}@{d}.org" for c in "abcdefghijklmnopqrstuvwxyz" for d in [*"klmnopqrstuvwxyzabcd", "e"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(rows, "k").collect()]
    assert len(out) == 546 == len(set(out)) and not set(out) & set(texts)
    # The space of a first attempt holds 823,875 names.
    names = spark.range(1_000_000).select(F.lit("family.latin").alias("kind"), F.concat(F.lit("n"), "id").alias("canon"))
    assigned = pii.assign_surrogates(names, "k")
    assert assigned.count() == 1_000_000 == assigned.select("surrogate").distinct().count()
    # Every two-digit number is taken, so each needs one of three digits.
    full = spark.range(100).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 2, "0").alias("canon"))
    wider = [r.surrogate for r in pii.assign_surrogates(full, "k").collect()]
    assert len(set(wider)) == 100 and all(w.isdigit() and len(w) > 2 for w in wider)


def test_a_name_is_one_entity_under_all_titles(spark):
    import re
    texts = ["Dr. Anna Smith met Mrs. Anna Smith", "Mr. Kim Lee, Mrs. Kim Lee and Prof. Kim Lee", "Herr Otto Smith", "Dr. Otto Smith"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(rows, "k").orderBy("doc_id").collect()]
    anna = re.fullmatch(r"Dr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)", out[0])
    assert anna[1] == anna[3] and anna[2] == anna[4] and anna[1].endswith(("ra", "lia", "nna"))
    kim = re.fullmatch(r"Mr\. (\w+) (\w+), Mrs\. (\w+) (\w+) and Prof\. (\w+) (\w+)", out[1])
    assert kim[1] == kim[3] == kim[5] and kim[1].endswith(("ler", "son", "ley"))
    assert out[2].split()[1:] == out[3].split()[1:] and out[2].split()[1].endswith(("ro", "ten", "us"))


def test_formats_of_numbers(spark):
    found = ["3782 822463 10005", "4111.1111.1111.1111", "+49 (0)30 123-456-78", "0049 30 123456", "123 45 6789"]
    left = ["5551234567", "030 1234567", "12 000 000", "see 1.2.3", "2024-01-15"]
    rows = spark.createDataFrame([(i, f"x {t}, y") for i, t in enumerate(found + left)], "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(rows, "k").orderBy("doc_id").collect()]
    for before, after in zip(found, out):
        assert after != f"x {before}, y" and [c.isdigit() for c in after] == [c.isdigit() for c in f"x {before}, y"]
    assert out[len(found):] == [f"x {t}, y" for t in left]


def _like(pattern, text):
    """The surface's shape: what a surrogate must keep of it."""
    import re
    return re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text)))


def test_pii_by_brute_force(spark):
    """Detection by Python's patterns, one replacement for each entity and none twice, all else untouched."""
    import regex
    from presswork.llm import queries
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: (r.text or "", r.n_entities) for r in pii.replace_entities(docs, "k").collect()}
    pattern = regex.compile(pii.PATTERN.replace("\\p{Is", "\\p{"))
    forward, backward = {}, {}
    for key, text in texts.items():
        new, count = after[key]
        hits = list(pattern.finditer(text))
        assert count == len(hits)
        gaps = [text[a:b] for a, b in zip([0, *(h.end() for h in hits)], [*(h.start() for h in hits), len(text)])]
        made = regex.fullmatch("(.+?)".join(map(regex.escape, gaps)), new, regex.DOTALL)
        assert made, key
        for hit, other in zip(hits, made.groups()):
            if "@" not in hit[0] and not regex.match(pii._TITLES, hit[0]):
                assert _like(pattern, other) == _like(pattern, hit[0]) or regex.fullmatch(r"[0-9a-fA-F]{32,}|[\d.]+", hit[0])
            canon = regex.sub(r"[^\w@+]", "", hit[0]).lower()
            surrogate = regex.sub(r"[^\w@+]", "", other).lower()
            assert forward.setdefault(canon, surrogate) == surrogate
            assert backward.setdefault(surrogate, canon) == canon and surrogate != canon
    assert len(forward) >= 10


def test_balltree_visits_few_shards(spark, monkeypatch):
    """Vectors in far groups: a query's best rows are in a few shards, and only those are searched."""
    dice = np.random.default_rng(2)
    centres = dice.normal(0, 4000, (24, 8))
    rows = [(i, np.floor(centres[i % 24] + dice.normal(0, 20, 8)).tolist()) for i in range(2400)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    visits, balls, usual = [], [], balltree._visits

    def counted(state, table, skip, most):
        out = usual(state, table, skip, most)
        visits.append(out.count())
        balls.append(table.num_rows)
        return out
    monkeypatch.setattr(balltree, "_visits", counted)
    got = balltree.top_inner_products(frame, F.col("vec_id") % 20 == 0, shard_rows=100, query_rows=50)
    exact = [(i, [int(x) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute(exact, {i for i, _ in rows if i % 20 == 0}, 10)
    assert balls[0] >= 20 and sum(visits) < 0.5 * 120 * balls[0] and visits[-1] == 0


def test_balltree_repeated_ids(spark):
    """Two rows of one id are two queries, and each is a candidate for the other."""
    rows = [(10, [9.0, 0.0]), (10, [0.0, 9.0]), *[(i, [float(i), float(12 - i)]) for i in range(1, 9)], (3, [3.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted(tuple(r) for r in balltree.top_inner_products(frame, F.col("vec_id") % 10 == 0, k=4, shard_rows=3).collect())
    wanted = []
    for at, (own, query) in enumerate(rows):
        if own % 10 == 0:
            scored = sorted((-int(np.dot(query, v)), i) for n, (i, v) in enumerate(rows) if n != at)[:4]
            wanted += [(own, rank, i, -score) for rank, (score, i) in enumerate(scored, 1)]
    assert got == sorted(wanted)


def test_kept_trees(spark, vocabulary, tokenizer):
    """Batches of edits on kept trees: counts as of the whole text, and only what is touched is encoded."""
    dice = random.Random(12)
    texts = {1: " ".join(dice.choices(WORDS, k=6000)), 2: "", 3: None, 4: "solid" * 500, 5: "short text"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trees = edits.token_trees(frame, vocabulary).cache()
    kind = "doc_id long, edits array<struct<start:int,stop:int,text:string>>"
    for turn in range(4):
        changes = {}
        for key, text in texts.items():
            at = dice.randrange(len(text or "") + 1)
            new = dice.choice(["", " new words ", "x", " ".join(dice.choices(WORDS, k=900)) if turn == 1 else "y z"])
            changes[key] = [(at, at + dice.choice([0, 5, 60]), new), None]
            start, stop = at, min(max(changes[key][0][1], at), len(text or ""))
            texts[key] = (text or "")[:start] + new + (text or "")[stop:]
        asked = trees.join(spark.createDataFrame(list(changes.items()), kind), "doc_id")
        done = edits.edit_trees(asked, vocabulary).cache()
        for row in done.collect():
            assert "".join(leaf.text for leaf in row.tree) == texts[row.doc_id]
            assert row.n_after == len(tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids)
            assert sum(leaf.n_tokens for leaf in row.tree) == row.n_after
            if row.doc_id == 1:
                # A long insertion is encoded once and lies in short leaves from then on.
                assert row.n_encoded <= 2000 + len(changes[1][0][2])
                assert max(len(leaf.text) for leaf in row.tree) < 2000
        trees = done.select("doc_id", "tree")


@pytest.mark.parametrize("kind", ["both or neither", "one of two"])
def test_factorization_learns_a_pair_neutral_alone(spark, kind):
    """Neither term tells anything alone; the label is whether both or none stand in the text."""
    dice = random.Random(15)
    rows = []
    for i in range(3000):
        words = dice.choices(WORDS, k=20)
        one, other = dice.random() < 0.5, dice.random() < 0.5
        rows.append((int((one == other) == (kind == "both or neither")), " ".join(words + ["alpha"] * one + ["gamma"] * other)))
    machine = toxicity.train(spark.createDataFrame(rows[:2400], "label int, text string"))
    scored = toxicity.score(spark.createDataFrame(rows[2400:], "label int, text string"), machine).collect()
    assert sum((r.score >= 0.5) == r.label for r in scored) >= 0.9 * len(scored)


def test_score_by_the_plain_formula(spark):
    """The constant, the weights of the terms there, and the products of all their pairs of factors."""
    import math
    import zlib
    dice = random.Random(16)
    rows = [(int(i % 3 == 0), " ".join(dice.choices(WORDS, k=15) + ["bad"] * (i % 3 == 0) + ["folk"] * (i % 2))) for i in range(400)]
    machine = toxicity.train(spark.createDataFrame(rows, "label int, text string"))
    texts = [text for _, text in rows[:30]] + ["", None, "BAD folk", "bad bad_folk bad"]
    places = {int(b): i for i, b in enumerate(machine.buckets)}
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in toxicity.score(frame, machine).collect():
        names = {n for t in toxicity.terms_of(row.text) for n in [t, *(t[:k] + "-" for k in range(3, min(8, len(t))))]}
        known = sorted({places[b] for n in names if (b := zlib.crc32(n.encode()) % toxicity.BUCKETS) in places})
        total = machine.constant + sum(machine.weights[i] for i in known)
        total += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(known) for j in known[n + 1:])
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_toxicity_without_both_labels(docs, spark):
    for rows in ([], [(1, "bad words")] * 9, [(0, "good words")] * 9):
        machine = toxicity.train(spark.createDataFrame(rows, "label int, text string"))
        assert all(r.score < 1e-9 for r in toxicity.score(docs, machine).collect())


STAGE_ROWS = [
    (1, "Mr. John Smith wrote to a.b@mail.org", "en", "src0", 10, -7.0, 5, 6), (1, "Mr. John Smith wrote to a.b@mail.org", "en", "src0", 10, -7.0, 5, 6),
    (None, "no id here", "en", "src1", 3, -7.0, 5, 6), (None, None, None, None, None, -7.0, 5, 6), (2, "", "de", "src2", 0, -7.0, 5, 6),
    (2, "other text of a repeated id", "de", None, 0, -7.0, 5, 6), (3, LONG, "en", "src1", 9, -7.0, 5, 6)]
STAGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _toxicity double, copy_no int, "
                "mix_key long")


@pytest.mark.parametrize("labels", [[], [(1, 0, 1), (2, 0, 1)], [(1, 0, 0)]])
def test_stages_keep_rows_and_columns(spark, tmp_path, labels):
    """NULL and repeated ids, empty texts, labels of one kind, and columns named like the stages' own."""
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(STAGE_ROWS, STAGE_SCHEMA).repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, frame, str(tmp_path))
        kept[name] = docs.collect()
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
        if name != "encode_texts":
            assert docs.columns == frame.columns
            assert {(r["_toxicity"], r.copy_no, r.mix_key) for r in kept[name]} <= {(-7.0, 5, 6)}
    assert len(kept["reject_toxic"]) == len(STAGE_ROWS)
    assert len(kept["drop_near_duplicates"]) == len(STAGE_ROWS) - 1
    assert len(kept["replace_personal_data"]) == len(kept["encode_texts"]) == len(STAGE_ROWS)
    assert not any("Smith" in (r.text or "") or "a.b@" in (r.text or "") for r in kept["replace_personal_data"])
    assert {r.text for r in kept["mix_sources"]} <= {r[1] for r in STAGE_ROWS}


def test_documents_cross_one_exchange_in_mixing(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "text " * 50) for i in range(300)], "doc_id long, source string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        rows = mixing.replicate(docs, mixing.repetition_rates(docs, {"s0": 2.0}))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[:plan.index("BroadcastHashJoin")]
    assert above.count("Exchange") == 1 and "SortMergeJoin" not in plan
