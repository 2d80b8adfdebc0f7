"""Token counts kept up under edits: segment trees over runs of pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from presswork.llm import bpe
from presswork.llm.workers import map_batches

#: Characters of a leaf, at least; it ends with the white space that follows.
LEAF_CHARACTERS = 256


class TokenTree:
    """A text in leaves that end in white space, with character and token sums above them.

    Neither pre-tokens nor merges nor normal forms reach over white space, so the
    leaves' counts add up to the whole text's.
    """

    def __init__(self, text: str, own: bpe.Encoder):
        self.own, self.encoded = own, 0
        leaves = self._cut(text)
        self._plant(leaves, [self._count(leaf) for leaf in leaves])

    @classmethod
    def kept(cls, leaves: list[str], counts: list[int], own: bpe.Encoder) -> "TokenTree":
        """The tree of leaves whose counts are known; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.own, tree.encoded = own, 0
        tree._plant(leaves or [""], counts or [0])
        return tree

    def _plant(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves, self.base = leaves, 1
        while self.base < len(leaves):
            self.base *= 2
        self.characters, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.characters[self.base:self.base + len(leaves)] = map(len, leaves)
        self.tokens[self.base:self.base + len(leaves)] = counts
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def counts(self) -> list[int]:
        """The leaves' own counts."""
        return self.tokens[self.base:self.base + len(self.leaves)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        leaves, start = [], 0
        while start < len(text):
            space = bpe.SPACES.search(text, start + LEAF_CHARACTERS)
            end = space.end() if space else len(text)
            leaves.append(text[start:end])
            start = end
        return leaves or [""]

    def _count(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return len(self.own.encode(leaf)) // 4

    def _sum(self, i: int) -> None:
        self.characters[i] = self.characters[2 * i] + self.characters[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str) -> None:
        """Replaces a leaf's text, its counts and the sums above it."""
        self.leaves[leaf] = text
        i = self.base + leaf
        self.characters[i], self.tokens[i] = len(text), self._count(text)
        while i > 1:
            i //= 2
            self._sum(i)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and the place in it."""
        i = 1
        while i < self.base:
            i *= 2
            if at >= self.characters[i] and self.characters[i + 1]:
                at -= self.characters[i]
                i += 1
        return min(i - self.base, len(self.leaves) - 1), at

    def edit(self, start: int, stop: int, text: str) -> None:
        """Puts ``text`` in place of the characters from ``start`` to ``stop``.

        Only the leaves touched are encoded again, and next to them those that no
        longer stand apart by white space. What has grown long is cut into leaves again.
        """
        length = self.characters[1]
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        low, from_ = self._find(start)
        high, to = self._find(stop)
        merged = self.leaves[low][:from_] + text + self.leaves[high][to:]
        while not self._apart(merged) and (after := self._beside(high, 1)) is not None \
                and not bpe.SPACES.match(self.leaves[after]):
            high, merged = after, merged + self.leaves[after]
        while merged and not bpe.SPACES.match(merged) and (before := self._beside(low, -1)) is not None \
                and not self._apart(self.leaves[before]):
            low, merged = before, self.leaves[before] + merged
        pieces = self._cut(merged) if len(merged) > 4 * LEAF_CHARACTERS else [merged]
        if len(pieces) > high - low + 1:
            # More leaves than there is room for: the sums are made anew, other leaves' counts stay.
            counts = self.counts()
            self._plant(self.leaves[:low] + pieces + self.leaves[high + 1:],
                        counts[:low] + [self._count(p) for p in pieces] + counts[high + 1:])
            return
        for leaf in range(low, high + 1):
            self._set(leaf, pieces[leaf - low] if leaf - low < len(pieces) else "")

    @staticmethod
    def _apart(leaf: str) -> bool:
        return bool(leaf) and bool(bpe.SPACES.match(leaf, len(leaf) - 1))

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves):
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def total(self) -> int:
        return self.tokens[1]


def _apply(tree: TokenTree, changes: list[dict] | None) -> None:
    """The edits in order; ``tree.encoded`` is then the characters encoded for them."""
    tree.encoded = 0
    for change in changes or []:
        if change is not None:
            start = change["start"] or 0
            tree.edit(start, start if change["stop"] is None else change["stop"], change["text"] or "")


_TREE = ArrayType(StructType([StructField("text", StringType()), StructField("n_tokens", IntegerType())]))
_ARROW_TREE = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32())]))


def _as_leaves(tree: TokenTree) -> list[dict]:
    return [{"text": t, "n_tokens": n} for t, n in zip(tree.leaves, tree.counts()) if t]


def token_trees(docs: DataFrame, vocabulary: Broadcast, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``doc_id``, ``tree``): every whole text as its leaves, each with its count, to be stored.

    The sums above the leaves follow from them. NULL and empty texts have no leaves.
    """
    schema = StructType([StructField("doc_id", docs.schema[key].dataType), StructField("tree", _TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(vocabulary)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                trees = [_as_leaves(TokenTree(body.as_py() or "", own)) for body in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, _ARROW_TREE)], names=schema.names)

    return map_batches(docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text")), run, schema, holds=True)


def edit_trees(trees: DataFrame, vocabulary: Broadcast, edits: str = "edits", tree: str = "tree",
               key: str = "doc_id") -> DataFrame:
    """Applies ``edits`` (see ``count_edited``) to kept trees, and gives them back for the next edits.

    Gives ``doc_id``, ``n_before``, ``n_after``, ``n_encoded`` and ``tree``. Only what the
    edits touch is encoded, whatever the text's length and however often it was edited.
    A NULL tree is that of an empty text.
    """
    schema = StructType([
        StructField("doc_id", trees.schema[key].dataType), StructField("n_before", LongType()),
        StructField("n_after", LongType()), StructField("n_encoded", LongType()), StructField("tree", _TREE)])
    types = [pa.int64(), pa.int64(), pa.int64(), _ARROW_TREE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(vocabulary)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                rows = []
                for leaves, changes in zip(batch.column(1), batch.column(2)):
                    kept = leaves.as_py() or []
                    held = TokenTree.kept([k["text"] for k in kept], [k["n_tokens"] for k in kept], own)
                    before = held.total
                    _apply(held, changes.as_py())
                    rows.append((before, held.total, held.encoded, _as_leaves(held)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=schema.names)

    return map_batches(trees.select(
        trees[key].alias("doc_id"), trees[tree].alias("tree"), trees[edits].alias("edits")), run, schema, holds=True)


def count_edited(docs: DataFrame, vocabulary: Broadcast, edits: str = "edits", text: str = "text",
                 key: str = "doc_id") -> DataFrame:
    """Token counts of every whole text before and after its edits.

    ``edits`` is an array of (``start``, ``stop``, ``text``) in characters, each on the text
    that the edits before it have left; places outside the text mean its ends, NULL
    edits and parts mean no change, 0, 0 and an empty text. Gives ``doc_id``,
    ``n_before``, ``n_after``, ``n_leaves``, ``n_encoded`` (characters encoded for the edits)
    and ``edited`` (the new text). A NULL text counts as empty. Rows stay where they are.
    """
    schema = StructType([
        StructField("doc_id", docs.schema[key].dataType), StructField("n_before", LongType()),
        StructField("n_after", LongType()), StructField("n_leaves", IntegerType()),
        StructField("n_encoded", LongType()), StructField("edited", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(vocabulary)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                rows = []
                for body, changes in zip(batch.column(1), batch.column(2)):
                    tree = TokenTree(body.as_py() or "", own)
                    before, leaves = tree.total, len(tree.leaves)
                    _apply(tree, changes.as_py())
                    rows.append((before, tree.total, leaves, tree.encoded, tree.text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(column, field.type) for column, field in
                                        zip(zip(*rows), _ARROW)]], names=schema.names)

    return map_batches(docs.select(
        docs[key].alias("doc_id"), docs[text].cast("string").alias("text"), docs[edits].alias("edits")),
        run, schema, holds=True)


_ARROW = [pa.field("n_before", pa.int64()), pa.field("n_after", pa.int64()), pa.field("n_leaves", pa.int32()),
          pa.field("n_encoded", pa.int64()), pa.field("edited", pa.string())]
