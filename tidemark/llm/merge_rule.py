"""The merge rule of BPE models as a scan: a text's pieces are the one chain in which neighbours fit.

Two pieces fit if merging their joined characters gives just these two. If all neighbours of a chain fit, merging the
whole text gives the chain: the first merge across one of its borders would also be made in the two pieces alone,
since merges elsewhere don't change what stands between them. The other way round, pieces that merging gives fit. So
a path's value is 0 if all its neighbours fit and minus infinity otherwise, one path has the value 0, and a state at
a border is the piece that reaches or crosses it.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.pieces import codes_of, marked
from tidemark.llm.token_counts import Merger
from tidemark.llm.unigram_rule import KEPT, Coder
from tidemark.llm.words import WordLists

#: A chain's start, which fits each piece that merging its own characters gives; and no piece at all.
START, NOTHING = -2, -3
#: So many pairs are kept in a worker.
PAIRS = 100_000


class Chains:
    """Transfer matrices of the merge rule. A state is (characters before the border, covered characters beyond it) of
    the piece there; state 0 is the start or the end of a text. As one path at most joins a state and a place, a matrix
    is kept as [state, covered beyond the end]: the characters of the last piece, 0 where the value is minus infinity."""

    def __init__(self, longest: int):
        self.longest = longest
        self.places = [(0, 0), *((s, e) for s in range(1, longest + 1) for e in range(longest - s + 1))]
        self.number = np.zeros((longest + 1, longest), np.int64)
        for k, (s, e) in enumerate(self.places):
            self.number[s, e] = k

    def load(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.int8).reshape(len(self.places), self.longest)

    def covered(self, state: int) -> int:
        return self.places[state][1]

    def after(self, sizes: np.ndarray) -> np.ndarray:
        """The state behind each entry of rows of a matrix; one beyond the last state where there is none."""
        beyond = np.arange(self.longest)
        return np.where(sizes > 0, self.number[np.maximum(sizes - beyond, 0), beyond], len(self.places))

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        none = np.zeros((1, self.longest), np.int8)
        return np.concatenate([b, none])[self.after(a)].max(axis=1)

    def states(self, matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
        """The states at all borders of a row of matrices on the path from `entry` to `leave`."""
        at, rows = np.array([entry]), []
        for m in matrices:
            rows.append(at)
            to = self.after(m[at].max(axis=0))
            at = to[to < len(self.places)]
        out = [leave]
        for at, m in zip(reversed(rows), reversed(matrices)):
            before, beyond = self.places[out[-1]]
            sizes = m[at, beyond]
            hit = np.flatnonzero(sizes == before + beyond if out[-1] else sizes > 0)
            out.append(int(at[hit[0]]))
        return out[::-1]


class MergeCoder(Coder):
    """Encodes words and parts of words by the merge rule of a BPE model."""

    def __init__(self, path: str):
        super().__init__(path)
        self.merger = Merger(path)
        self.words = WordLists("sentencepiece merges", lambda words: self.solve([marked(w) for w in words]), KEPT)
        self.chains = Chains(self.vocab.longest)
        self.fitting: dict[tuple[int, int], bool] = {}
        self.letters = {i: p for p, i in self.vocab.symbols.items()}

    def algebra(self) -> Chains:
        return self.chains

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings after all merges: how many each, and the ids end to end."""
        n, sym, code = self.merger.symbols(words)
        odd = np.flatnonzero((sym < 0) | (sym >= self.vocab.size))
        if not len(odd):
            return n, sym
        size = np.ones(len(sym), np.int64)
        lists = [self.vocab.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in code[odd].tolist()]
        size[odd] = [len(x) for x in lists]
        out = np.repeat(sym, size)
        at = np.cumsum(size) - size
        for k, own in zip(at[odd].tolist(), lists):
            out[k : k + len(own)] = own
        word = np.repeat(np.arange(len(n)), n)
        return np.bincount(word, weights=size, minlength=len(n)).astype(np.int64), out

    # --- chunks ---

    def _symbol(self, piece: str) -> int:
        """The symbol of some characters; for one character in no piece a number of its own, for other strings NOTHING."""
        found = self.vocab.symbols.get(piece, NOTHING)
        return self.vocab.size + len(self.vocab.symbols) + ord(piece) if found == NOTHING and len(piece) == 1 else found

    def _string(self, symbol: int) -> str:
        odd = symbol - self.vocab.size - len(self.vocab.symbols)
        return "" if symbol == START else chr(odd) if odd >= 0 else self.letters[symbol]

    def _learn(self, pairs: set[tuple[int, int]]) -> None:
        """Which of the pairs fit, by merging each one's characters."""
        if len(self.fitting) > PAIRS:
            self.fitting.clear()
        new = [p for p in pairs if p not in self.fitting]
        if not new:
            return
        strings = [self._string(a) + self._string(b) for a, b in new]
        n, sym, code = self.merger.symbols(strings)
        own = np.where(sym >= 0, sym, self.vocab.size + len(self.vocab.symbols) + code.astype(np.int64))
        end = np.cumsum(n)
        for pair, k, to in zip(new, n.tolist(), end.tolist()):
            self.fitting[pair] = tuple(own[to - k : to].tolist()) == (pair[1:] if pair[0] == START else pair)

    def _chains(self, text: str, entries: list[tuple[int, int]], inside: int) -> list[list[tuple[int, int]]]:
        """For each entry (symbol before, its end): at each place the last piece (symbol, characters) of the one chain that
        gets there by pieces that start before `inside`; (NOTHING, 0) where there is none."""
        flat, n = codes_of([text])[0], len(text)
        table = self.vocab.pieces_at(flat, np.array([n]))
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for k, a in zip(*(x.tolist() for x in np.nonzero(table >= 0))):
            if a < inside:
                ends[a + k + 1].append((int(table[k, a]), k + 1))
        for a in np.flatnonzero(table[0] < 0).tolist():
            if a < inside:
                ends[a + 1].append((self._symbol(text[a]), 1))
        left: list[set[int]] = [{p for p, _ in own} for own in ends]
        for symbol, at in entries:
            if at <= n:
                left[at].add(symbol)
        self._learn({(a, p) for t in range(1, n + 1) for p, k in ends[t] for a in left[t - k]})
        out, fitting = [], self.fitting
        for symbol, at in entries:
            last = [(NOTHING, 0)] * (n + 1)
            if at <= n:
                last[at] = (symbol, 0)
                for t in range(at + 1, n + 1):
                    for p, k in ends[t]:
                        if t - k >= at and last[t - k][0] != NOTHING and fitting[last[t - k][0], p]:
                            last[t] = (p, k)
                            break
                last[at] = (NOTHING, 0) if at > inside else last[at]
            out.append(last)
        return out

    def _entry(self, before: str, chunk: str, state: int) -> tuple[int, int]:
        s, e = self.chains.places[state]
        return (START, 0) if state == 0 else (self._symbol(before[len(before) - s :] + chunk[:e]), e)

    def matrix(self, before: str, chunk: str, inside: int, is_first: bool) -> np.ndarray:
        """Rows of the states that the characters around the chunk's start allow."""
        out = np.zeros((len(self.chains.places), self.chains.longest), np.int8)
        live = [0] if is_first else [k for k, (s, e) in enumerate(self.chains.places) if 0 < s <= len(before) and e <= len(chunk)]
        entries = {k: self._entry(before, chunk, k) for k in live}
        entries = {k: v for k, v in entries.items() if v[0] != NOTHING}
        first, last = self._cut(chunk, inside)
        if first < 0:
            for k, own in zip(entries, self._chains(chunk, list(entries.values()), inside)):
                sizes = [size for _, size in own[inside : inside + self.chains.longest]]
                out[k, : len(sizes)] = sizes
            return out
        heads = self._chains(chunk[:first], list(entries.values()), first)
        tail = self._chains(chunk[last:], [(START, 0)], inside - last)[0][inside - last :][: self.chains.longest]
        for k, own in zip(entries, heads):
            if own[first][0] != NOTHING:
                out[k, : len(tail)] = [size for _, size in tail]
        return out

    def trace(self, before: str, chunk: str, inside: int, entry: int, leave: int) -> np.ndarray:
        """Ids of the pieces that start in the chunk, on the chain between the given states."""
        begin, end = self._entry(before, chunk, entry), inside + self.chains.covered(leave)
        first, last = self._cut(chunk, inside)

        def part(text: str, start: tuple[int, int], to: int, within: int) -> np.ndarray:
            own, found = self._chains(text, [start], within)[0], []
            while to > start[1]:
                symbol, size = own[to]
                if symbol < self.vocab.size:
                    found.append([symbol])
                else:
                    found.append(self.vocab.byte_ids[list(self._string(symbol).encode("utf-8", "surrogatepass"))].tolist())
                to -= size
            return np.array([i for ids in reversed(found) for i in ids], np.int64)

        if first < 0:
            return part(chunk, begin, end, inside)
        return np.r_[part(chunk[:first], begin, first, first), self._middle(chunk, first, last)[1], part(chunk[last:], (START, 0), end - last, inside - last)]
