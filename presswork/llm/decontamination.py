"""Benchmark decontamination: suffix arrays of the training words, searched for every suffix of the items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, IntegerType, LongType, StringType, StructField, StructType)

from presswork.llm.workers import map_batches, with_text
from presswork.session import shared_folder

#: Consecutive words that are a match; an item of fewer words matches as a whole.
WINDOW = 10
#: Words of documents that share a suffix array, beside those of the last document.
SHARD_WORDS = 1 << 20
#: Bytes of items that are searched for at once, on average; more are searched block by block.
ITEM_BYTES = 8 << 20

#: Separators become spaces and A to Z small; digits, small letters and all beyond ASCII are words.
_FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
              for b in range(256))

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
LONGEST = StructType([StructField("n_words", IntegerType()), StructField("start", IntegerType()),
                      StructField("item_id", StringType()), StructField("item_start", IntegerType())])


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a whole UTF-8 text, A to Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def _runs(codes: np.ndarray) -> np.ndarray:
    """For each place, how many codes follow from there on before the next 0."""
    ends = np.flatnonzero(codes == 0)
    places = np.arange(len(codes))
    return ends[np.searchsorted(ends, places)] - places


def suffix_array(codes: np.ndarray, depth: int, least: int, letters: int) -> np.ndarray:
    """The places before which ``least`` codes or more follow without a 0, sorted by their next ``depth`` codes.

    ``codes`` are at most ``letters`` and end with a 0; a 0 ends every suffix before it.
    As many codes as 63 bits hold are compared at once; only places that are still equal
    are sorted again by the codes after those.
    """
    bits = max(int(letters).bit_length(), 1)
    width = max(min(63 // bits, depth), 1)
    packed = np.zeros(len(codes), np.int64)
    alive = np.ones(len(codes), bool)
    padded = np.append(codes, np.zeros(width, codes.dtype))
    for k in range(width):
        code = padded[k:k + len(codes)]
        alive &= code != 0
        packed = (packed << bits) | np.where(alive, code, 0)
    run = _runs(codes)
    places = np.flatnonzero(run >= max(least, 1))
    group = np.zeros(len(places), np.int64)
    open_at = np.arange(len(places))
    for offset in range(0, depth, width):
        if not len(open_at):
            break
        own = places[open_at]
        key = np.where(run[own] > offset, packed[np.minimum(own + offset, len(codes) - 1)], 0)
        order = np.lexsort((key, group[open_at]))
        own, key, before = own[order], key[order], group[open_at]
        places[open_at] = own
        # Groups keep their slots, so they are numbered by the slot of their first member.
        new = np.append(True, (key[1:] != key[:-1]) | (before[1:] != before[:-1]))
        group[open_at] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        single = new & np.append(new[1:], True)
        open_at = open_at[~single & (run[own] > offset + width)]
    return places


def _ranges(array: np.ndarray, codes: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple:
    """For each window (a row of codes, ``sizes`` of them used) where its places in the array begin and end.

    Binary search of all windows together.
    """
    span = np.arange(windows.shape[1])
    used = span < sizes[:, None]
    last = len(codes) - 1
    bounds = []
    for after_equal in (False, True):
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(array))
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) // 2
            there = codes[np.minimum(array[mid][:, None] + span, last)]
            differ = (there != windows[active]) & used[active]
            first = differ.argmax(axis=1)[:, None]
            sign = np.take_along_axis(there, first, 1)[:, 0].astype(np.int64) - np.take_along_axis(windows[active], first, 1)[:, 0]
            equal = ~differ.any(axis=1)
            below = np.where(equal, after_equal, sign < 0)
            low[active] = np.where(below, mid + 1, low[active])
            high[active] = np.where(below, high[active], mid)
            active = active[low[active] < high[active]]
        bounds.append(low)
    return tuple(bounds)


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many codes agree from a[i] and b[j] on before a 0, known to be ``start`` at least."""
    length, step = start.copy(), 16
    active = np.arange(len(i))
    while len(active):
        at = length[active, None] + np.arange(step)
        x = a[np.minimum(i[active, None] + at, len(a) - 1)]
        y = b[np.minimum(j[active, None] + at, len(b) - 1)]
        same = (x == y) & (x != 0)
        whole = same.all(axis=1)
        length[active] += np.where(whole, step, same.argmin(axis=1))
        active, step = active[whole], min(2 * step, 1024)
    return length


class Items:
    """A block of items: their words numbered from 1, their windows, and their sorted suffixes."""

    def __init__(self, ids: list[str], texts: list[bytes | None], window: int = WINDOW):
        lists = [words_of(t) for t in texts]
        self.ids = [i for i, w in zip(ids, lists) if w]
        lists = [w for w in lists if w]
        self.numbers = {w: n for n, w in enumerate(sorted({w for words in lists for w in words}), 1)}
        sizes = np.array([len(w) for w in lists], np.int64)
        self.starts = np.cumsum(np.append(0, sizes + 1))
        self.codes = np.zeros(int(self.starts[-1]) + 1, np.int32)
        for start, words in zip(self.starts, lists):
            self.codes[start:start + len(words)] = [self.numbers[w] for w in words]
        # A window begins wherever WINDOW words follow, and at the start of a shorter item.
        per_item = np.maximum(sizes - window + 1, 1)
        owners = np.repeat(np.arange(len(lists)), per_item)
        firsts = np.arange(len(owners)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        self.places = self.starts[owners] + firsts
        lengths = np.minimum(sizes[owners], window)
        rows = np.where(np.arange(window) < lengths[:, None],
                        self.codes[np.minimum(self.places[:, None] + np.arange(window), len(self.codes) - 1)], 0)
        rows = np.column_stack([rows, lengths]).astype(np.int32).reshape(-1, window + 1)
        distinct, self.kinds = np.unique(rows, axis=0, return_inverse=True)
        self.kinds = self.kinds.reshape(-1)
        self.windows, self.sizes = distinct[:, :window], distinct[:, window].astype(np.int64)
        self.least = int(self.sizes.min()) if len(distinct) else 0
        pairs = np.unique(np.column_stack([self.kinds, owners]).reshape(-1, 2), axis=0)
        self.of_kind = np.split(pairs[:, 1], np.cumsum(np.bincount(pairs[:, 0], minlength=len(distinct)))[:-1])
        # The kind of window before a kind's ones, where that is always the same one.
        before = np.where(firsts > 0, np.append(-2, self.kinds)[:len(self.kinds)], -2)
        low, high = np.full(len(distinct), len(rows)), np.full(len(distinct), -2)
        np.minimum.at(low, self.kinds, before)
        np.maximum.at(high, self.kinds, before)
        self.before = np.where(low == high, low, -2)
        longest = int(sizes.max()) if len(sizes) else 1
        self.suffixes = suffix_array(self.codes, longest, 1, len(self.numbers))

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; words that no item holds are 0."""
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))

    def longest_from(self, codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest agreement of the codes from each place with any item, and where that lies in the items.

        A binary search among the items' suffixes; the neighbours at which it ends agree longest.
        Codes known to agree with both ends of the range are not compared again.
        """
        n, suffixes = len(places), self.suffixes
        low, high = np.full(n, -1), np.full(n, len(suffixes))
        with_low, with_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = np.arange(n)
        while len(active := active[high[active] - low[active] > 1]):
            mid = (low[active] + high[active]) // 2
            there = suffixes[mid]
            common = _common(codes, places[active], self.codes, there,
                             np.minimum(with_low[active], with_high[active]))
            own = codes[np.minimum(places[active] + common, len(codes) - 1)]
            up = own >= self.codes[there + common]
            low[active], high[active] = np.where(up, mid, low[active]), np.where(up, high[active], mid)
            with_low[active] = np.where(up, common, with_low[active])
            with_high[active] = np.where(up, with_high[active], common)
        below = with_low >= with_high
        at = np.where(below, low, high).clip(0, max(len(suffixes) - 1, 0))
        return np.maximum(with_low, with_high), suffixes[at]

    def search(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[set[str]], list]:
        """What of documents, given as codes with a 0 after each, stands in the items.

        Which places are hit, the ids found in each document, and its longest match as
        (words, place in the document, id, place in the item), or None.
        """
        hit = np.zeros(len(codes), bool)
        ids, longest = [set() for _ in starts], [None] * len(starts)
        if not len(self.windows) or not len(codes):
            return hit, ids, longest
        array = suffix_array(codes, int(self.sizes.max()), self.least, len(self.numbers))
        first, last = _ranges(array, codes, self.windows, self.sizes)
        times = last - first
        total = int(times.sum())
        if not total:
            return hit, ids, longest
        kinds = np.repeat(np.arange(len(times)), times)
        places = array[np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, places, 1)
        np.add.at(edges, places + self.sizes[kinds], -1)
        hit = np.cumsum(edges)[:-1] > 0
        docs = np.searchsorted(starts, places, side="right") - 1
        for doc, kind in np.unique(np.column_stack([docs, kinds]), axis=0):
            ids[doc].update(self.ids[item] for item in self.of_kind[kind])
        # A place that goes on the same match as the place before it begins no longest one.
        found = np.full(len(codes) + 1, -1)
        found[places] = kinds
        begins = (found[places - 1] != self.before[kinds]) | (self.sizes[kinds] < self.windows.shape[1])
        begins |= found[places] != kinds
        places = np.unique(places[begins | (self.before[kinds] < 0)])
        for part in np.split(places, range(65_536, len(places), 65_536)):
            lengths, others = self.longest_from(codes, part)
            docs = np.searchsorted(starts, part, side="right") - 1
            order = np.lexsort((part, -lengths, docs))
            for at in order[np.unique(docs[order], return_index=True)[1]]:
                doc, item = docs[at], np.searchsorted(self.starts, others[at], side="right") - 1
                if longest[doc] is None or lengths[at] > longest[doc][0]:
                    longest[doc] = (int(lengths[at]), int(part[at] - starts[doc]), self.ids[item],
                                    int(others[at] - self.starts[item]))
        return hit, ids, longest


def _stored(items: DataFrame, key: str, text: str) -> str:
    """Writes the items to a folder that all executors share, in files of about ITEM_BYTES."""
    narrow = items.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_folder(items.sparkSession, "benchmark")
    narrow.repartition(max(1, -(-size // ITEM_BYTES))).write.parquet(folder)
    return folder


def _blocks(folder: str, window: int) -> Iterator[Items]:
    files, root = fs.FileSystem.from_uri(folder)
    for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            rows = pq.read_table(info.path, filesystem=files)
            yield Items(rows.column("id").to_pylist(), rows.column("text").to_pylist(), window)


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Adds what each whole text of ``docs`` shares verbatim with the items of a benchmark.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, compared
    with A to Z in lower case. Documents are taken in shards of about SHARD_WORDS words.
    A shard's suffix array is searched for every suffix of every item; what a search
    finds are all occurrences of the suffix's first ``window`` words, or of an item of
    fewer words as a whole, and from there the longest agreement with any item. Words
    that no item holds end every match, so suffixes that are cut by one within the
    shortest window are left out of the array. Nothing is shuffled.

    Adds ``n_words`` (long), ``n_hit`` (long, the words inside any occurrence), ``spans``
    (the words hit, as ranges from ``start`` to before ``stop``), ``items`` (the ids found
    as text, sorted) and ``longest`` (words, place in the document, item and place in it;
    the first of several; NULL without a hit). They replace columns of those names;
    ``keep`` names the columns that stay (all if not given).

    NULL and empty texts have no words. Items without words are never found; repeated
    ids count once; a NULL id is an empty one. The items are written to the shared
    folder and read by the tasks block by block, so neither a task nor the driver holds a
    benchmark larger than a block (or a single item, if that is longer).
    """
    new = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()),
                      StructField("spans", SPANS), StructField("items", ArrayType(StringType())),
                      StructField("longest", LONGEST)])
    columns = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    schema = StructType([docs.schema[c] for c in columns] + new.fields)
    narrow, at = with_text(docs, columns, text)
    folder = _stored(items, item_key, item_text)

    def shard(texts: list[bytes], blocks) -> list[tuple]:
        words = hit = ids = longest = None
        for block in blocks():
            parts = [block.encode(words_of(t)) for t in texts]
            sizes = np.array([len(p) for p in parts], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            codes = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
            for start, part in zip(starts, parts):
                codes[start:start + len(part)] = part
            more_hit, more_ids, more_longest = block.search(codes, starts)
            if words is None:
                words, hit, ids, longest = sizes, more_hit, more_ids, more_longest
                continue
            hit |= more_hit
            for own, more in zip(ids, more_ids):
                own |= more
            longest = [max((m for m in pair if m), key=lambda m: (m[0], -m[1]), default=None)
                       for pair in zip(longest, more_longest)]
        rows = []
        for start, size, found, most in zip(starts, words, ids, longest):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[start:start + size], [0]])))
            spans = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
            rows.append((int(size), sum(s["stop"] - s["start"] for s in spans), spans, sorted(found),
                         dict(zip(LONGEST.names, most)) if most else None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[Items] = []
        several = False

        def blocks() -> Iterator[Items]:
            # A single block is kept for the next shards, several are read again.
            nonlocal several
            if known and not several:
                yield known[0]
                return
            for number, block in enumerate(_blocks(folder, window)):
                several = several or number > 0
                known[:] = [block]
                yield block
            if not known:
                known.append(Items([], [], window))
                yield known[0]
        for batch in batches:
            sizes = batch.column(at).cast(pa.large_binary())
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                # Six bytes a word, as a bound for the cut only.
                while start + len(texts) < batch.num_rows and size < 6 * SHARD_WORDS:
                    texts.append(sizes[start + len(texts)].as_py() or b"")
                    size += len(texts[-1])
                rows = shard(texts, blocks)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(columns)],
                     *[pa.array(list(c), _ARROW[f.name]) for c, f in zip(zip(*rows), new.fields)]],
                    names=schema.names)
                start += len(texts)

    return map_batches(narrow, run, schema)


_ARROW = {
    "n_words": pa.int64(), "n_hit": pa.int64(),
    "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
    "items": pa.list_(pa.string()),
    "longest": pa.struct([("n_words", pa.int32()), ("start", pa.int32()),
                          ("item_id", pa.string()), ("item_start", pa.int32())])}


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a word inside an occurrence of an item's window."""
    hits = "_contaminated"
    while hits in docs.columns:
        hits = f"_{hits}"
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(hits)
    found = find_matches(docs.select(whole, F.col(f"`{text}`").alias("text")), items, keep=[hits], **options)
    return found.filter("n_hit = 0").select(f"{hits}.*")
