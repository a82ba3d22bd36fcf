"""What a Python worker keeps about the distinct words that it has met, so that each is worked out once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidemark.llm.common import ragged


class _Numbers(dict):
    """Numbers its keys in the order in which they are asked for, and notes the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


#: Bytes that a word's string, number and place in a dictionary take besides its letters.
OBJECTS = 160

#: What is kept in this worker, by whose it is. A worker serves many stages; only the last owner's words stay.
_KEPT: dict[str, list[WordRows]] = {}


def _only(owner: str) -> None:
    for other in [o for o in _KEPT if o != owner]:
        for kept in _KEPT.pop(other):
            kept.clear()
    _KEPT.setdefault(owner, [])


class WordRows:
    """Rows of a table of arrays, by word; begun anew when the words held take more than about `most` bytes."""

    def __init__(self, owner: str, work: Callable[[list[str]], tuple[np.ndarray, ...]], most: int = 32 << 20):
        self.owner, self.work, self.most = owner, work, most
        self.clear()

    def clear(self) -> None:
        self.row = _Numbers()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word; words not met before are worked out together."""
        if self.owner not in _KEPT or len(_KEPT) > 1:
            _only(self.owner)
        if not any(k is self for k in _KEPT[self.owner]):
            _KEPT[self.owner].append(self)
        if self.held > self.most:
            self.clear()
        found = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        if self.row.new:
            made = self.work(self.row.new)
            self.parts.append(made)
            self.held += sum(map(len, self.row.new)) + OBJECTS * len(self.row.new) + sum(x.nbytes for x in made)
            self.row.new = []
        return found

    def column(self, k: int) -> np.ndarray:
        """Column k of the table, one row for each word."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(c) for c in zip(*self.parts))]
        return self.parts[0][k]


class _Growing:
    """A numpy array that numbers are added to, with room for more."""

    def __init__(self) -> None:
        self.held, self.size = np.zeros(1024, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            room = np.zeros(2 * (self.size + len(more)), np.int64)
            room[: self.size] = self.held[: self.size]
            self.held = room
        self.held[self.size : self.size + len(more)] = more
        self.size += len(more)


class WordLists(WordRows):
    """A list of numbers for each word: `work` gives the lengths of the words' lists, and the lists end to end. When the
    words held take too much, those that were asked for most stay, at most half of them."""

    def clear(self) -> None:
        super().clear()
        self.starts, self.lengths, self.flat, self.asked = (_Growing() for _ in range(4))

    def gather(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length of each word's list, where it starts in the flat lists, the flat lists)."""
        if self.held > self.most:
            self._keep_half()
        rows = self.rows(words)
        for lengths, flat in self.parts:
            self.starts.add(self.flat.size + np.cumsum(lengths) - lengths)
            self.lengths.add(lengths)
            self.flat.add(flat)
            self.asked.add(np.zeros(len(lengths), np.int64))
        self.parts = []
        np.add.at(self.asked.held, rows, 1)
        return self.lengths.held[rows], self.starts.held[rows], self.flat.held

    def _keep_half(self) -> None:
        """Forget the words asked for least; a word's count is halved, so that old ones go in the end."""
        size, counts = len(self.row), self.asked.held[: len(self.row)]
        keep = np.flatnonzero(counts > max(1, int(np.median(counts))))
        words = np.array(list(self.row), object)[keep].tolist()
        lengths, starts, flat = self.lengths.held[:size][keep], self.starts.held[:size][keep], self.flat.held
        own, counts = flat[ragged(starts, lengths)], counts[keep] // 2
        self.clear()
        self.row.update(zip(words, range(len(words))))
        self.starts.add(np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.flat.add(own)
        self.asked.add(counts)
        self.held = sum(map(len, words)) + OBJECTS * len(words) + lengths.nbytes + own.nbytes
