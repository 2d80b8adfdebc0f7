"""The operators' queries against SQL or brute force on the smallest tables, and the pipeline."""

import collections
import hashlib
import os
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries as all_queries
from oracle_compare import connect, spark_result, sql_result
from presswork.llm import quality, queries, samples

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    with connect(SF_DIR) as connection:
        yield connection


@pytest.fixture(scope="module")
def texts(sql):
    return dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(all_queries())
    assert set(queries.ORACLE) <= set(oracle_sql())
    assert {re.match(r"op(\d+)_", name)[1] for name in queries.QUERIES} == {str(i) for i in range(1, 14)}


@pytest.mark.parametrize("name", queries.ORACLE)
def test_against_sql(name, spark, sql):
    assert spark_result(queries.QUERIES[name](spark, SF_DIR)) == sql_result(sql, queries.ORACLE[name])


def test_bpe(spark, texts, tokenizer):
    rows = queries.op1_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def test_quality_statistics(spark, texts):
    rows = queries.op2_quality_rules(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_words, *_, repeated = expected = statistics(texts[row.doc_id] or "")
        assert tuple(row)[1:6] == expected
        assert row.base_failed == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert not (row.base_failed and row.kept)


def test_training_order(spark, texts, tokenizer):
    """Every sequence by its list of documents: together they hold each text once, and the sums are of their bytes."""
    rows = sorted(queries.op5_training_order(spark, SF_DIR).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    ids = {i: [*own, queries.END_ID] for i, own in ids.items() if own}
    found = collections.defaultdict(list)
    for row in rows:
        assert row.shard == row.slot // queries.SHARD_SEQUENCES
        assert row.offset == row.slot % queries.SHARD_SEQUENCES * 2 * queries.SEQUENCE
        held = [queries.END_ID] * queries.SEQUENCE
        for part in row.docs:
            held[part.start:part.start + part.n_tokens] = ids[part.doc_id][part.doc_start:part.doc_start + part.n_tokens]
            found[part.doc_id].append((part.doc_start, part.n_tokens))
        assert sum(part.n_tokens for part in row.docs) == row.n_tokens
        assert row.crc32 == zlib.crc32(struct.pack(f"<{queries.SEQUENCE}H", *held))
    assert set(found) == set(ids)
    for doc, parts in found.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[doc])
    # Only the last sequence of a partition is not full.
    assert sum(r.n_tokens < queries.SEQUENCE for r in rows) <= 8


def test_edited_counts(spark, texts, tokenizer):
    edits = queries.table(spark, SF_DIR, "documents").select("doc_id", queries.derived_edits().alias("e"))
    changes = {r.doc_id: r.e for r in edits.collect()}
    for row in queries.op7_edited_counts(spark, SF_DIR).collect():
        text = texts[row.doc_id] or ""
        assert row.n_before == len(tokenizer.encode(text, add_special_tokens=False).ids)
        for start, stop, new in changes[row.doc_id]:
            start, stop = min(start, len(text)), min(stop, len(text))
            text = text[:start] + (new or "") + text[stop:]
        assert row.edited_sha256 == sha(text)
        assert row.n_after == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert row.n_encoded <= 12 * (256 + 400)


def test_toxicity_of_held_out_rows(spark, sql):
    labels = dict(sql.execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = queries.op9_toxicity(spark, SF_DIR).collect()
    assert {r.held_out for r in rows} == {True, False}
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= queries.TOXIC_FROM)
    wrong = [r for r in rows if r.doc_id in labels and labels[r.doc_id] == 0 and r.predicted]
    assert len(wrong) <= 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_toxicity_accuracy(spark):
    rows = queries.op9_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_pipeline(spark, sql, texts, tokenizer):
    """Each stage on what the one before it kept, by brute force."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        docs.persist()
        kept[name] = docs.collect()
        if name != "encode_texts":
            assert docs.columns == columns
    scores = {r.doc_id: r.predicted for r in queries.op9_toxicity(spark, SF_DIR).collect()}
    assert {r.doc_id for r in kept["reject_toxic"]} == {i for i, p in scores.items() if not p}
    sets = {}
    for row in kept["reject_toxic"]:
        words = row.text.encode().lower().split()
        sets[row.doc_id] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                one, other = sorted((root(a), root(b)))
                parent[other] = one
    assert {r.doc_id for r in kept["drop_near_duplicates"]} == {i for i in ids if root(i) == i}
    private = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b")
    after = {r.doc_id: r.text for r in kept["replace_personal_data"]}
    assert set(after) == {r.doc_id for r in kept["drop_near_duplicates"]}
    for row in kept["drop_near_duplicates"]:
        found = private.findall(row.text)
        assert not any(f in after[row.doc_id] for f in found)
        assert found or re.search(r"\d", row.text) or after[row.doc_id] == row.text
    copies = collections.Counter(r.doc_id for r in kept["mix_sources"])
    assert set(copies) <= set(after) and all(r.text == after[r.doc_id] for r in kept["mix_sources"])
    encoded = kept["encode_texts"]
    assert collections.Counter(r.doc_id for r in encoded) == copies
    for row in encoded:
        assert row.ids == tokenizer.encode(after[row.doc_id], add_special_tokens=False).ids


def features(text):
    """What rules compare, counted here."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = statistics(text)
    per_word, per_line, per_char = max(n_words, 1), max(len(lines), 1), max(word_chars, 1)
    return {
        "word_length": word_chars / per_word, "symbol_share": n_symbols / per_word, "dup_line_share": n_dup_lines / per_line,
        "repeat_share": n_repeat / per_word, "words_per_line": n_words / per_line, "distinct_share": len(set(words)) / per_word,
        "capital_share": len(re.findall("[A-Z]", text)) / per_char, "digit_share": len(re.findall("[0-9]", text)) / per_char,
        "mark_share": len(re.findall("[!?]", text)) / per_word, "words": n_words}


def test_quality_verdict(spark, texts):
    """``kept`` by the learned list, applied condition by condition to features counted here."""
    docs, labels = (queries.table(spark, SF_DIR, name) for name in ("documents", "labels"))
    rules = quality.learn_rules(quality.text_statistics(samples.labelled_sample(docs, labels, "quality")))
    for row in queries.op2_quality_rules(spark, SF_DIR).collect():
        values = features(texts[row.doc_id] or "")
        marked = any(all((values[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        assert row.kept == (not row.base_failed and not marked), row.doc_id
    assert rules
