"""Token counts by rank-synchronous merging (operator 2).

The distinct words of a batch of documents become ragged arrays of symbols. In each round every word finds the pair
with the lowest rank that it holds and merges it, all words together; when no word holds a pair that is a piece, the
symbols that survive are counted. Characters in no piece count as their UTF-8 bytes, as byte fallback gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, small_batches, text_slices
from tidemark.llm.pieces import PairTable, codes_of, marked, split_words, vocabulary
from tidemark.llm.words import WordRows

NONE = np.iinfo(np.int64).max
#: Words merged together hold about so many characters.
TOGETHER = 200_000


class Merger:
    """The merges of a model: the pairs of symbols that make a piece."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        keys, self.ranks, self.ids, self.width = self.vocab.merges()
        self.table = PairTable(keys)
        #: Pieces that, once made, can be part of a pair as good as themselves or better.
        own = np.full(self.width, NONE)
        own[self.ids] = self.ranks
        self.risky = np.zeros(self.width, bool)
        for part in (keys // self.width, keys % self.width):
            self.risky[part[(own[part] < NONE) & (self.ranks <= own[part])]] = True

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and id of the piece that each pair makes."""
        k = self.table.rows(left * self.width + right)
        ok = (k >= 0) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[k], NONE), self.ids[k]

    def _parts(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of words that are merged together: words of like length end after about as many rounds."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        group = np.cumsum(lengths[order]) // TOGETHER
        yield from np.split(order, np.flatnonzero(np.diff(group)) + 1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each string, of any length."""
        out = np.zeros(len(words), np.int64)
        for part in self._parts(words):
            word, sym, code = self._merged([words[i] for i in part.tolist()])
            size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)  # UTF-8 bytes
            known = (sym < self.vocab.size) & (sym >= 0)
            out[part] = np.bincount(word, weights=np.where(known, 1, size), minlength=len(part))
        return out

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many symbols each string keeps; all symbols end to end (-1: a character in no piece), and their first code points."""
        found = []
        for part in self._parts(words):
            word, sym, code = self._merged([words[i] for i in part.tolist()])
            found.append((part[word], sym, code))
        word, sym, code = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(words)), sym[order], code[order]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, symbol, first code point) of the symbols that survive; those of a word are in order."""
        code, lengths = codes_of(words)
        sym = self.vocab.of_code[code].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), NONE)  # of the pair of a symbol and the next one
        inside = np.flatnonzero(word[:-1] == word[1:]) if len(sym) else np.zeros(0, np.int64)
        rank[inside] = self.look(sym[inside], sym[inside + 1])[0]
        ended = [(word[:0], sym[:0], code[:0])]
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sym)]))
            done = lowest == NONE
            if done.any():
                out = done[of]
                ended.append((word[out], sym[out], code[out]))
                keep = ~out
                sym, word, rank, code = sym[keep], word[keep], rank[keep], code[keep]
                continue
            sym, word, rank, code = self._round(sym, word, rank, code, np.flatnonzero(rank == lowest[of]))
        return tuple(np.concatenate(c) for c in zip(*ended))

    def _round(self, sym, word, rank, code, at):
        """Merge each word's lowest pair wherever it stands, from left to right, as far as no better pair arises."""
        # Of pairs that share a symbol the left one is merged: keep every second one of a run.
        new_run = np.r_[True, np.diff(at) != 1]
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        now, (_, made) = rank[at], self.look(sym[at], sym[at + 1])
        n = len(sym)
        if self.risky[made].any():
            at, made = self._until_better(sym, word, at, now, made)
        sym[at] = made
        keep = np.ones(n, bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, word, code, rank = sym[keep], word[keep], code[keep], rank[keep]
        at = moved[at]
        changed = np.zeros(len(sym) + 1, bool)
        changed[at] = changed[at - 1] = True  # at -1 stands the spare last one
        near = np.flatnonzero(changed[:-1])
        rank[near] = NONE
        near = near[near + 1 < len(sym)]
        near = near[word[near] == word[near + 1]]
        rank[near] = self.look(sym[near], sym[near + 1])[0]
        return sym, word, rank, code

    def _until_better(self, sym, word, at, now, made):
        """The merges of each word up to the first one that brings a pair as good as itself or better."""
        n = len(sym)
        # The pairs beside each merge, when all merges to its left are done and none to its right.
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        joined = np.r_[False, at[1:] - at[:-1] == 2]
        left = np.where(joined, np.r_[0, made[:-1]], sym[before])
        has_left, has_right = (at > 0) & (word[before] == word[at]), (at + 2 < n) & (word[after] == word[at])
        left_rank = np.where(has_left, self.look(left, made)[0], NONE)
        right_rank = np.where(has_right, self.look(made, sym[after])[0], NONE)
        better = np.minimum(left_rank, right_rank) <= now
        stop = np.cumsum(better) - better
        start = np.flatnonzero(np.r_[True, word[at[1:]] != word[at[:-1]]])
        keep = stop == np.repeat(stop[start], np.diff(np.r_[start, len(at)]))
        return at[keep], made[keep]


@lru_cache(maxsize=2)
def _words(path: str) -> WordRows:
    merger = Merger(path)
    return WordRows("token counts", lambda words: (merger.counts([marked(w) for w in words]),))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each document, without special tokens.

    A null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated and rows stay one to one; other
    columns are not read. Texts may have any length: words are merged in parts of bounded size. Strings that look
    like control tokens are ordinary text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _words(model)
        for batch, texts in text_slices(batches):
            words = [split_words(t) for t in texts]
            rows = kept.rows([w for ws in words for w in ws])
            ends = np.cumsum([len(ws) for ws in words])
            sums = np.r_[0, np.cumsum(kept.column(0)[rows])] if len(rows) else np.zeros(1, np.int64)
            n = sums[ends] - sums[np.r_[0, ends[:-1]]]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
