"""What a Python worker remembers about words it has met."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import getsizeof

#: Bytes that each of two generations of a map may take, about, in each Python worker.
REMEMBERED = 24 << 20
#: Bytes of a map's own for each word.
_SLOT = 104
#: The same with what a string and bytes take besides their characters, at two bytes each.
_PAIR = _SLOT + getsizeof("") + getsizeof(b"")


class Memory:
    """A map from words to results, bounded in bytes; what was used lately stays."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        self.make, self.limit, self.young, self.old, self.size = make, limit, {}, {}, 0

    def __call__(self, word):
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.make(word)
            self.put(word, found)
        return found

    def put(self, word, found) -> None:
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[word] = found
        self.size += getsizeof(word) + getsizeof(found) + _SLOT

    def put_all(self, words: list, found: list) -> None:
        """The same for many strings with bytes, which may go beyond the limit by their own size."""
        if self.size >= self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young.update(zip(words, found))
        self.size += 2 * sum(map(len, words)) + sum(map(len, found)) + _PAIR * len(words)

    def lists(self, lists: list[list], make_all: Callable[[list], list]) -> Iterator[list]:
        """The results for many lists of words; ``make_all`` gives those of the new words together."""
        found = [list(map(self.young.get, words)) for words in lists]
        missed = {word for words, results in zip(lists, found) if None in results
                  for word, result in zip(words, results) if result is None}
        kept = {word: result for word in missed if (result := self.old.get(word)) is not None}
        new = list(missed.difference(kept))
        kept.update(zip(new, make_all(new)))
        self.put_all(list(kept), list(kept.values()))
        for words, results in zip(lists, found):
            yield results if None not in results else [
                kept[word] if result is None else result for word, result in zip(words, results)]

    def all(self, words: list[str]) -> list:
        found = list(map(self.young.get, words))
        if None in found:
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self(words[at])
        return found

    def joined(self, words: list[str]) -> bytes:
        """The results, which are bytes, in a row."""
        try:
            return b"".join(map(self.young.get, words))
        except TypeError:
            # One of them is not among the young.
            return b"".join(self.all(words))
