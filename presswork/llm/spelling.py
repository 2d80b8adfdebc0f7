"""Spelling variants: words one edit apart, found by pairs of nodes of a forward and a reversed trie."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from presswork.llm.workers import map_batches
from presswork.operators.ids import assign_ids
from presswork.session import durable_table

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 200_000
#: Nodes of so many letters or fewer are numbered by their letters, 21 bits each.
SHALLOW = 3
#: Nodes deeper than this are known by a 128-bit digest of their letters instead of the letters.
SPELLED = 24
#: Rows of nodes that a task hands on at once.
ROWS = 50_000


def corrupted_runs(text: str | None, doc_id: str, one_in: int = 97) -> Counter:
    """The runs of letters of a whole text, A to Z in lower case, some without one letter, and their counts.

    A run whose checksum with the document's id is divisible by ``one_in`` loses the
    letter that the checksum points at.
    """
    runs = Counter(_RUN.findall((text or "").encode().lower().decode()))
    start = zlib.crc32(f"{doc_id}:".encode())
    words = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % one_in == 0:
            run = run[:h % len(run)] + run[h % len(run) + 1:]
        words[run] += n
    return words


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", one_in: int = 97,
                least_length: int = 5, least_rows: int = 3) -> DataFrame:
    """(``word``, ``n``): the runs of all texts with ``least_length`` letters that occur ``least_rows`` times.

    Counted inside the tasks before anything is shuffled, so a word may be most of all
    words. NULL and empty texts have none; a NULL key counts as an empty one.
    """
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            listed = [w for w in counts if len(w) >= least_length]
            return pa.RecordBatch.from_arrays(
                [pa.array(listed, pa.string()), pa.array([counts[w] for w in listed], pa.int64())],
                names=schema.names)
        for batch in batches:
            for name, item in zip(batch.column(0), batch.column(1)):
                for word, n in corrupted_runs(item.as_py(), name.as_py() or "", one_in).items():
                    counts[word] += n
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    counted = map_batches(docs.select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("text")),
                          run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_rows)


def _shallow(letters: str) -> int:
    """A number below 0 for a node of at most SHALLOW letters, different for each."""
    number = 0
    for letter in letters:
        number = number << 21 | ord(letter) + 1
    return -number - 1


def node_keys(word: str) -> list[int | bytes]:
    """For each beginning of a word, the empty one first: its number, or the key by which it is numbered."""
    keys: list[int | bytes] = [_shallow(word[:i]) for i in range(min(SHALLOW, len(word)) + 1)]
    keys += [word[:i].encode() for i in range(SHALLOW + 1, min(SPELLED, len(word)) + 1)]
    if len(word) > SPELLED:
        digest = hashlib.blake2b(word[:SPELLED].encode(), digest_size=16)
        for letter in word[SPELLED:]:
            digest.update(letter.encode())
            # No text begins with this byte, so digests and letters do not meet.
            keys.append(b"\xff" + digest.copy().digest())
    return keys


_NODES = StructType([
    StructField("id", LongType()), StructField("n", LongType()),
    StructField("at", IntegerType()), StructField("run", IntegerType()),
    StructField("p", LongType()), StructField("pk", BinaryType()),
    StructField("s", LongType()), StructField("sk", BinaryType())])


def _paths(words: DataFrame) -> DataFrame:
    """A row for each place ``at`` in a word, from 0 to its length: the nodes before and from there.

    ``p`` and ``s`` number shallow nodes of the forward and the reversed trie, ``pk`` and
    ``sk`` are the keys of others. The word's count goes along as ``n``. ``run`` is 1 where
    the letter at the place differs from the one before, 0 where it repeats it, and -1 at the end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(),
                                                          pa.binary(), pa.int64(), pa.binary()))],
                names=_NODES.names)
        for batch in batches:
            for number, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                before, after = node_keys(word), node_keys(word[::-1])[::-1]
                for at, (p, s) in enumerate(zip(before, after)):
                    same = -1 if at == len(word) else int(at == 0 or word[at] != word[at - 1])
                    rows.append((number, n, at, same, *((p, None) if isinstance(p, int) else (None, p)),
                                 *((s, None) if isinstance(s, int) else (None, s))))
                    if len(rows) >= ROWS:
                        yield out()
                        rows.clear()
        if rows:
            yield out()

    return map_batches(words.select("id", "word", "n"), run, _NODES)


def _numbered(paths: DataFrame, key: str, name: str) -> DataFrame:
    """``paths`` with all nodes of one trie numbered in ``name``."""
    nodes = durable_table(paths.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(
        "_node", F.monotonically_increasing_id()))
    deep = paths.filter(F.col(key).isNotNull()).drop(name).join(nodes, key).withColumnRenamed("_node", name)
    return paths.filter(F.col(key).isNull()).drop(key).unionByName(deep.drop(key))


def near_words(words: DataFrame) -> DataFrame:
    """Per word with one: ``id``, ``n_near`` (words one edit away), and the most frequent of them.

    ``words`` has ``id`` (long, rising with the word), ``word`` and ``n``. ``near_n`` and
    ``near_id`` are the count and the id of the most frequent near word, the first one of
    several. Two words with the same node before and the same node after a skipped letter
    differ by that letter; a word whose nodes before and after a place are those around a
    skipped letter of another lacks that letter. Of a letter that is repeated only the
    first is skipped for that, as the others give the same word. So every pair of near
    words meets under exactly one pair of nodes, and the words that meet there differ in a
    single place: they are no more than there are letters. Pairs are counted by their
    nodes and never listed.
    """
    stored = durable_table(_paths(words))
    paths = _numbered(_numbered(stored, "pk", "p"), "sk", "s")
    # Skipping the letter at a place joins the node before it with the one after it.
    in_word = Window.partitionBy("id").orderBy("at")
    places = paths.withColumn("_after", F.lead("s").over(in_word))
    pairs = F.array(F.struct("p", F.col("_after").alias("s"), "run"), F.struct("p", "s", F.lit(-1).alias("run")))
    nodes = places.select("id", "n", F.explode(pairs).alias("_")).select("id", "n", "_.*").filter("s IS NOT NULL")
    member = F.struct("n", (-F.col("id")).alias("order"), "run")
    met = nodes.groupBy("p", "s").agg(
        F.sort_array(F.collect_list(member), asc=False).alias("members")).filter(F.size("members") > 1)
    # Sorted by falling n and rising word. ``run`` is -1 for the word without the letter.
    each = met.select("members", F.explode("members").alias("own"))
    others = F.filter("members", lambda m: (m["order"] != F.col("own.order")) & F.when(
        m["run"] == -1, F.col("own.run") == 1).when(
        F.col("own.run") == -1, m["run"] == 1).otherwise(True))
    near = each.select(F.col("own.order").alias("order"), others.alias("near")).filter(F.size("near") > 0)
    best = F.struct(F.col("near")[0]["n"].alias("n"), F.col("near")[0]["order"].alias("order"))
    return near.select("order", F.size("near").cast("long").alias("times"), best.alias("best")).groupBy("order").agg(
        F.sum("times").alias("n_near"), F.max("best").alias("best")).select(
        (-F.col("order")).alias("id"), "n_near", F.col("best.n").alias("near_n"), (-F.col("best.order")).alias("near_id"))


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(``id``, ``root``) for each of (``id``, ``form_id``): the last of the forms that follow each other.

    Pointers are doubled each round, so rounds grow with the logarithm of the longest way.
    """
    steps = durable_table(forms.select("id", F.col("form_id").alias("root")))
    for _ in range(max_rounds):
        further = steps.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = durable_table(steps.join(further, "root", "left").select(
            "id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if moved.filter("_moved").isEmpty():
            return moved.select("id", "root")
        steps = moved.select("id", "root")
    raise RuntimeError("forms follow each other without an end")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Groups words with the words one edit away that are ``ratio`` times as frequent or more.

    ``words`` has ``word`` and ``n``; counts of a repeated word are added up. Gives ``word``, ``form`` (its near word of
    the largest n, the first in code-point order of several, if that n is at least ``ratio``
    times its own; else NULL), ``root`` (the last form that is reached, or the word itself),
    ``n``, ``n_near`` (near words, 0 if none) and ``form_n``. Near are words that differ by
    one letter inserted, deleted or replaced. NULL words are left out; an empty table gives
    an empty one; words may be of any length, in letters of any script.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    once = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n"))
    numbered = durable_table(assign_ids(once, ["word"]))
    near = durable_table(near_words(numbered))
    forms = durable_table(numbered.join(near, "id").filter(F.col("near_n") >= ratio * F.col("n")).select(
        "id", F.col("near_id").alias("form_id"), F.col("near_n").alias("form_n")))
    spelled = numbered.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    found = (forms.join(_roots(forms), "id")
             .join(spelled.toDF("form_id", "form"), "form_id")
             .join(spelled.toDF("root", "_root"), "root")
             .select("id", "form", F.col("_root").alias("root"), "form_n"))
    return (numbered.join(near.select("id", "n_near"), "id", "left").join(found, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
