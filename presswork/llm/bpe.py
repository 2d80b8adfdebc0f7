"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from presswork.llm.memory import Memory
from presswork.llm.workers import HELD, let_go, map_batches, with_text

#: Tokens after which a batch of results is handed on; worker and executor each hold a batch or two.
BATCH_TOKENS = 250_000
#: Characters of texts whose new words are merged at once, and the words of one merge; longer words,
#: by bytes, go one by one.
GROUP_CHARACTERS, BLOCK_WORDS, BLOCK_BYTES = 500_000, 4096, 32
#: What the vocabulary's patterns take as white space; Python's own split takes U+001C to U+001F too.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LETTERS = regex.compile(r"[\p{L}\p{N}]")
# Blocks of the letters and digits that Unicode 16 added.
_UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F),
    (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FF),
    (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF)]
# Lower case of letters newer than Python's tables.
_RECENT_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 32 for c in range(0x10D50, 0x10D66)},
    **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}}
_PLACE = (1 << 40) - 1
#: Stands for no merge, in a word's place and a merge's rank as one number.
_NONE = np.int32((1 << 31) - 1)
#: Symbols have 20 bits, two of them and a rank one number.
_RANK_BITS = 23
_CLASS = re.compile(r"\[[^\]]*\]")
_RUN = r"[\p{L}]+"


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs; read on the driver only.

    The file must hold byte-level BPE with a word-end suffix, as ``word_bpe_49k.json``
    does: NFC, runs of white space to a space, lower case, then a split by pattern.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                   if p["type"] == "Split")
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"{path} holds another kind of tokenizer")
    # Letters that Python's own tables lack; the pattern knows those of Unicode 16 only.
    letters = _LETTERS.findall("".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)])))
    recent = [c for c in letters if unicodedata.category(c) == "Cn"]
    newest = [c for c in recent if not any(a <= ord(c) <= b for a, b in _UNICODE_16)]
    return {
        "recent": "".join(recent), "newest": "".join(newest),
        "classes": {name: _ranges(name) for name in (r"\s", r"\p{L}", r"\p{N}")},
        "vocab": model["vocab"], "suffix": suffix, "pattern": pattern,
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def _ranges(name: str) -> str:
    """What a class of the pattern holds of the first plane, as ranges that any engine reads alike."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[0]) + len(run) - 1:04x}"
                   for run in regex.findall(f"[{name}]+", plane) for run in _unbroken(run))


def _unbroken(characters: str) -> list[str]:
    """Rising characters, cut where one is left out."""
    cuts = [i for i in range(1, len(characters)) if ord(characters[i]) != ord(characters[i - 1]) + 1]
    return [characters[a:b] for a, b in zip([0, *cuts], [*cuts, len(characters)])]


def _letters_first(pattern: str) -> str:
    """The same pattern, with its runs of letters tried first if all before them begins with an apostrophe."""
    parts = pattern.split("|")
    if _RUN in parts:
        at = parts.index(_RUN)
        if all(re.fullmatch(r"'\w+", part) for part in parts[:at]):
            parts.insert(0, parts.pop(at))
    return "|".join(parts)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Ranks:
    """The ranks of many pairs of symbols at once, from hashed tables of falling size.

    A key that finds its slot taken goes on to the next table, until none is left over.
    """

    def __init__(self, merges: dict[int, int]):
        keys = np.fromiter(merges.keys(), np.int64, len(merges))
        ranks = np.fromiter(merges.values(), np.int32, len(merges))
        self.tables = []
        while len(keys):
            shift = np.uint64(64 - max(6, (4 * len(keys)).bit_length()))
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            slots = self._slots(keys, factor, shift)
            taken, first = np.unique(slots, return_index=True)
            # A key and its rank in one number. No pair of symbols, nor one with -1 for a missing symbol, gives -2.
            table = np.full(1 << (64 - int(shift)), -2 << _RANK_BITS, np.int64)
            table[taken] = keys[first] << _RANK_BITS | ranks[first]
            self.tables.append((factor, shift, table))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks = keys[left], ranks[left]

    @staticmethod
    def _slots(keys: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        found = np.full(keys.shape, _NONE, np.int32)
        for factor, shift, table in self.tables:
            entries = table[self._slots(keys, factor, shift)]
            np.copyto(found, entries & ((1 << _RANK_BITS) - 1), where=entries >> _RANK_BITS == keys, casting="unsafe")
        return found


class Encoder:
    """Encodes and decodes single texts; one per Python worker."""

    def __init__(self, vocabulary: dict):
        vocab, suffix = vocabulary["vocab"], vocabulary["suffix"]
        characters = _byte_characters()
        self.inner = [vocab[c] for c in characters]
        self.final = [vocab[c + suffix] for c in characters]
        self.merges = {vocab[a] << 20 | vocab[b]: rank
                       for rank, (a, b) in enumerate(vocabulary["merges"])}
        self.merged = [vocab[a + b] for a, b in vocabulary["merges"]]
        self.ranks = _Ranks(self.merges)
        self.arrays = [np.array(x, np.int32) for x in (self.inner, self.final, self.merged)]
        # A place within a block's word stands below the rank in 31 bits.
        self.block_bytes = BLOCK_BYTES if len(self.merged) < _NONE // BLOCK_BYTES else 0
        self.pieces = [""] * (1 + max([*vocab.values(), *vocabulary["added"].values()]))
        for piece, i in [*vocab.items(), *vocabulary["added"].items()]:
            self.pieces[i] = piece
        self.pretokens = self.ascii_pretokens = self.plane_pretokens = regex.compile(vocabulary["pattern"])
        if not re.search(r"\\[ps]", _CLASS.sub("", vocabulary["pattern"])):
            # In ASCII texts the classes name these alone.
            listed = _letters_first(vocabulary["pattern"])
            plain = listed.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
            for name, ranges in vocabulary["classes"].items():
                listed = listed.replace(name, ranges)
            if "\\p" not in plain:
                self.ascii_pretokens, self.plane_pretokens = re.compile(plain, re.ASCII), re.compile(listed)
        #: Letters that Python's own tables lack, and all characters beyond the first plane.
        recent = "".join(c for c in vocabulary["recent"] if c < "\U00010000")
        self.beyond = re.compile(f"[{re.escape(recent)}\U00010000-\U0010ffff]")
        self.recent = frozenset(vocabulary["recent"])
        self.newest = {ord(c): "\ufffd" for c in vocabulary["newest"]}
        added = sorted(vocabulary["added"], key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.added_ids = {k: np.array([v], np.int32).tobytes() for k, v in vocabulary["added"].items()}
        self.words = Memory(self.merge)

    def merge(self, word: str) -> bytes:
        """The ids of one pre-token, as 32-bit integers.

        Possible merges wait in a queue by rank, then place. Symbols are a doubly
        linked list; an entry whose two symbols have changed since is skipped.
        """
        raw = word.encode()
        symbols = [*map(self.inner.__getitem__, raw)]
        symbols[-1] = self.final[raw[-1]]
        n, rank_of, new_of = len(symbols), self.merges.get, self.merged
        # A queue entry is a rank and a place in one number.
        queue = []
        left = symbols[0] << 20
        for at in range(1, n):
            right = symbols[at]
            rank = rank_of(left | right)
            if rank is not None:
                queue.append(rank << 40 | at - 1)
            left = right << 20
        if not queue:
            return array("i", symbols).tobytes()
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            at, rank = entry & _PLACE, entry >> 40
            left, right = symbols[at], after[at]
            if left < 0 or right == n or rank_of(left << 20 | symbols[right]) != rank:
                continue
            symbols[at] = new = new_of[rank]
            symbols[right] = -1
            after[at] = following = after[right]
            if following < n:
                before[following] = at
                rank = rank_of(new << 20 | symbols[following])
                if rank is not None:
                    heappush(queue, rank << 40 | at)
            preceding = before[at]
            if preceding >= 0:
                rank = rank_of(symbols[preceding] << 20 | new)
                if rank is not None:
                    heappush(queue, rank << 40 | preceding)
        return array("i", [s for s in symbols if s >= 0]).tobytes()

    def merge_all(self, words: list[str]) -> list[bytes]:
        """What ``merge`` gives for each of many pre-tokens."""
        raws = [w.encode() for w in words]
        found: list = [None] * len(raws)
        order = sorted(range(len(raws)), key=lambda i: len(raws[i]))
        short = [i for i in order if len(raws[i]) <= self.block_bytes]
        for i in order[len(short):]:
            found[i] = self.merge(words[i])
        for start in range(0, len(short), BLOCK_WORDS):
            places = short[start:start + BLOCK_WORDS]
            for i, ids in zip(places, self._merge_block([raws[i] for i in places])):
                found[i] = ids
        return found

    def _merge_block(self, raws: list[bytes]) -> list[bytes]:
        """The ids of short pre-tokens, merged side by side: in a round each word's merge of least rank, then place.

        Words are columns; the last row stands for no symbol before or after.
        """
        inner, final, merged = self.arrays
        n, sizes = len(raws), np.fromiter(map(len, raws), np.int64, len(raws))
        width, ends = int(sizes.max()), np.cumsum(sizes)
        flat = np.frombuffer(b"".join(raws), np.uint8)
        columns = np.repeat(np.arange(n), sizes)
        rows = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        symbols = np.full((width + 1, n), -1, np.int32)
        symbols[rows, columns] = inner[flat]
        symbols[sizes - 1, np.arange(n)] = final[flat[ends - 1]]
        after = np.repeat(np.arange(1, width + 2)[:, None], n, axis=1)
        after[sizes - 1, np.arange(n)] = width
        before = np.repeat(np.arange(-1, width)[:, None], n, axis=1)
        before[0] = width
        waiting = np.full((width + 1, n), _NONE, np.int32)

        def wait(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = self.ranks(left, right)
            return np.where(rank == _NONE, _NONE, rank * np.int32(BLOCK_BYTES) + place.astype(np.int32))
        waiting[:-1] = wait(symbols[:-1], symbols[1:], np.arange(width)[:, None])
        all_symbols, all_after, all_before, all_waiting = (x.reshape(-1) for x in (symbols, after, before, waiting))
        while True:
            least = waiting.min(axis=0)
            word = np.flatnonzero(least != _NONE)
            if not len(word):
                break
            rank, place = np.divmod(least[word].astype(np.int64), BLOCK_BYTES)
            at = place * n + word
            right = all_after[at] * n + word
            new = merged[rank]
            all_symbols[at], all_symbols[right], all_waiting[right] = new, -1, _NONE
            following = all_after[right]
            all_after[at] = following
            all_before[following * n + word] = place
            preceding = all_before[at]
            all_waiting[at] = wait(new, all_symbols[following * n + word], place)
            all_waiting[preceding * n + word] = wait(all_symbols[preceding * n + word], new, preceding)
        alive = symbols.T >= 0
        cuts = np.cumsum([0, *alive.sum(axis=1)]) * 4
        ids = symbols.T[alive].tobytes()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text. None holds white space, and no normal form reaches over it."""
        if text.isascii():
            return self.ascii_pretokens.findall(text.lower())
        # Letter by letter, so that a sigma at the end of a word is like any other.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self.beyond.search(text):
            return self.plane_pretokens.findall(text)
        if not self.recent.isdisjoint(text):
            text = text.translate(_RECENT_LOWER)
            return [text[slice(*m.span())] for m in self.pretokens.finditer(text.translate(self.newest))]
        return self.pretokens.findall(text)

    def plain(self, text: str) -> bytes:
        return self.words.joined(self.cut(text))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """What ``encode`` gives for each text, in their order; new words of a group are merged together."""
        group: list[tuple[str | None, list[str]]] = []
        size = 0

        def done() -> Iterator[bytes]:
            found = self.words.lists([words for _, words in group], self.merge_all)
            for (text, _), ids in zip(group, found):
                yield self.encode(text) if text else b"".join(ids)
        for text in texts:
            # A text with special tokens is cut at them first.
            special = text and "<" in text and self.added and self.added.search(text)
            group.append((text, []) if special else (None, self.cut(text or "")))
            size += len(text or "")
            if size >= GROUP_CHARACTERS:
                yield from done()
                group, size = [], 0
        yield from done()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as 32-bit integers; none for NULL."""
        if not text:
            return b""
        if "<" in text and self.added and self.added.search(text):
            return b"".join([self.added_ids[part] if part in self.added_ids else self.plain(part)
                             for part in self.added.split(text)])
        return self.plain(text)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, with a space between."""
        return " ".join(map(self.pieces.__getitem__, ids))


def encoder(vocabulary: Broadcast) -> Encoder:
    """This worker's encoder, with the words it remembers from earlier tasks; for functions that hold it."""
    if not HELD or HELD[0][0] is not vocabulary.value:
        let_go()
        HELD.append((vocabulary.value, Encoder(vocabulary.value)))
    return HELD[0][1]


def highest_id(vocabulary: Broadcast) -> int:
    return max(*vocabulary.value["vocab"].values(), *vocabulary.value["added"].values(), 0)


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for all workers. Its size is that of the file, whatever the data."""
    return spark.sparkContext.broadcast(load_vocabulary(path))


def encode(docs: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids",
           decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the token ids of every whole text and, if named, the text decoded from them.

    ``keep`` names the columns that stay (all of them if not given); ``ids`` and
    ``decoded`` replace columns of those names. NULL and empty texts have an empty
    list and an empty decoded text. Special tokens written out in a text become
    their ids. Work is linear in the text up to the queue's logarithm, also for a
    text that is a single word. Rows stay in their partitions; nothing is shuffled.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)]
    fields = [docs.schema[c] for c in columns] + [StructField(ids, ArrayType(IntegerType()))]
    if decoded:
        fields.append(StructField(decoded, StringType()))
    narrow, at = with_text(docs, columns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            kept = batch.columns[:len(columns)]
            rows, start, waiting = [], 0, 0
            for row, raw in enumerate(own.encode_all(t.as_py() for t in batch.column(at))):
                rows.append(raw)
                waiting += len(rows[-1]) // 4
                if waiting >= BATCH_TOKENS or row == batch.num_rows - 1:
                    yield _batch(own, [c.slice(start, len(rows)) for c in kept], rows,
                                 [f.name for f in fields], bool(decoded))
                    rows, start, waiting = [], row + 1, 0

    return map_batches(narrow, run, StructType(fields), holds=True)


def _batch(own: Encoder, kept: list[pa.Array], rows: list[bytes], names: list[str],
           decoded: bool) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    flat = np.frombuffer(b"".join(rows), np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    columns = [*kept, ids]
    if decoded:
        columns.append(pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])],
                                pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=names)


def decode(tokens: DataFrame, vocabulary: Broadcast, ids: str = "ids",
           decoded: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for: their vocabulary strings with a space between.

    NULL ids give NULL, no ids an empty text; an id outside the vocabulary, or NULL
    within the list, is an error. ``decoded`` replaces a column of that name.
    """
    columns = [c for c in tokens.columns if c != decoded]
    fields = [tokens.schema[c] for c in columns] + [StructField(decoded, StringType())]
    at = columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [None if row is None else own.decode(row)
                         for row in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[f.name for f in fields])

    return map_batches(tokens.select(*[tokens[c] for c in columns]), run, StructType(fields), holds=True)
