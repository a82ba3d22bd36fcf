"""Words and their near words (one letter inserted, deleted or replaced), by a bit-sliced index of letters by position.

The index has, for each position and letter, the set of words with that letter there, a bit a word. A word walks along
its own letters and keeps four sets as words of 64 bits: those that agree so far, those with one letter replaced, those
with one letter more (they are compared one place later) and those with one letter less (one place earlier). All words
of a block move at once. At the end, lengths tell which of the four sets count. Bits stand in the order of falling
counts, so the lowest bit is the best near word, and pairs are never written out.

Blocks: one change leaves either the first or the last half of a word as it is. For words of lengths L and L + 1, halves
have L // 2 letters: words with the same first half are a block, and so are words with the same last half, where
those whose first halves agree too are left to the other block. So each pair meets in just one block, and the work
grows with the blocks, not with the square of the vocabulary. A block of more than `HEAVY` words is dealt to several
tasks, which share its questions.

Counts cover whole texts; words of a batch are counted before they are shuffled. Defined cases: a null or empty text
has no words; of near words with equal counts the smaller in code-point order is the form. Other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, scratch, small_batches, stored, text_slices

#: A word's letters: Latin, with those of U+00C0 to U+00FF. Only A to Z are made small.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}
#: Least letters of a word, and least count.
LETTERS, COUNT = 5, 3
#: Words that a task counts before it sends them; words of one index; words of a block that one task asks about.
HELD, SLAB, HEAVY = 1 << 18, 1 << 11, 1 << 16
#: Letters times words of an index's matrix of questions.
CELLS = 1 << 22


def _counted(letters: int, change: Callable[[int | None, str], str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: dict[str, str] = {}
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for part, texts in text_slices(batches):
            for of, text in zip(part.column(0).to_pylist(), texts):
                for met, n in Counter(RUN.findall(text)).items():
                    word = small.get(met)
                    if word is None:
                        small[met] = word = met.translate(SMALL)
                    if change:
                        word = change(of, word)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                if len(small) > HELD:
                    small.clear()
        if held:
            yield out()

    return run


def words(docs: DataFrame, letters: int = LETTERS, least: int = COUNT, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n) of all words of (doc_id, text); `change` may give another word for a document's word."""
    small_batches(docs.sparkSession)
    met = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _counted(letters, change), "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((flags.shape[0], -(-flags.shape[1] // 64) * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Index:
    """The sets of words by position and letter. The words have lengths L and L + 1; `blocks` numbers their blocks."""

    def __init__(self, found: list[str], blocks: np.ndarray, length: int, last_half: bool):
        self.length, self.last_half, self.blocks = length, last_half, blocks
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        points = np.frombuffer("".join(w.ljust(length + 1, "\0") for w in found).encode("utf-32-le"), np.uint32).reshape(len(found), length + 1)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.codes = codes.reshape(points.shape)
        self.empty = np.flatnonzero(self.alphabet == 0)
        self.of_length = {m: _bits((self.sizes == m)[None, :])[0] for m in (length, length + 1)}
        self.made: dict[int, np.ndarray] = {}

    def at(self, position: int) -> np.ndarray:
        """The set of each letter at a position; none beyond a word's end."""
        if position not in self.made:
            if len(self.made) > 64:
                self.made.clear()
            flags = np.zeros((len(self.alphabet), len(self.codes)), bool)
            if 0 <= position <= self.length:
                flags[self.codes[:, position], np.arange(len(self.codes))] = True
                flags[self.empty] = False
            self.made[position] = _bits(flags)
        return self.made[position]

    def near(self, asked: np.ndarray) -> np.ndarray:
        """The sets of near words in their own block of words that have one length."""
        size, codes = int(self.sizes[asked[0]]), self.codes[asked]
        whole = _bits(self.blocks[asked][:, None] == self.blocks[None, :])
        same, more = whole.copy(), whole.copy()
        other, less = np.zeros_like(whole), np.zeros_like(whole)
        halves = whole
        for j in range(size):
            here = self.at(j)[codes[:, j]]
            if size == self.length:
                other = (other & here) | (same & ~here)
                more &= self.at(j + 1)[codes[:, j]]
                same &= here
                more |= same
            else:
                less = (less & self.at(j - 1)[codes[:, j]]) | same
                same &= here
            if j + 1 == self.length // 2:
                halves = same.copy()
        out = (other & self.of_length[size]) | (more & self.of_length[size + 1]) if size == self.length else less & self.of_length[size - 1]
        return out & ~halves if self.last_half else out


def _best(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many bits each row has, the lowest of them)."""
    first = np.argmax(sets != 0, axis=1)
    lowest = sets[np.arange(len(sets)), first]
    return np.bitwise_count(sets).sum(axis=1, dtype=np.int64), first * 64 + np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1))


def _asked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (length, last, half, salt, word, n, asks) of one length and side, whole blocks in order, to answers."""
    found, counts = [r[4] for r in rows], np.array([r[5] for r in rows], np.int64)
    keys = [r[2:4] for r in rows]
    blocks = np.cumsum([0, *(a != b for a, b in zip(keys[1:], keys))])
    index = Index(found, blocks, rows[0][0], rows[0][1])
    asks = np.array([r[6] for r in rows], bool) & (np.bincount(blocks)[blocks] > 1)
    together = max(1, CELLS // len(rows))
    for size in (index.length, index.length + 1):
        mine = np.flatnonzero(asks & (index.sizes == size))
        for k in range(0, len(mine), together):
            part = mine[k : k + together]
            n, best = _best(index.near(part))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in part[some]], pa.string()), pa.array(n[some]), pa.array([found[i] for i in best[some]], pa.string()), pa.array(counts[best[some]])], names=["word", "n_near", "form", "form_n"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[:2] != held[-1][:2] or len(held) >= SLAB and row[:4] != held[-1][:4]):
                yield from _asked(held)
                held = []
            held.append(row)
    if held:
        yield from _asked(held)


def near_words(vocabulary: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of (word, n): how many words are near, and the most counted of them."""
    small_batches(vocabulary.sparkSession)
    size = F.length("word")
    lengths = F.when(size > letters, F.array(size, size - 1)).otherwise(F.array(size))
    halves = vocabulary.select("word", "n", F.explode(lengths).alias("length")).select("word", "n", "length", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
    half = (F.col("length") / 2).cast("int")
    rows = halves.withColumn("half", F.when(F.col("last"), F.substr("word", F.length("word") - half + 1, half)).otherwise(F.substr("word", F.lit(1), half)))
    key = ["length", "last", "half"]
    heavy = rows.groupBy(*key).agg(F.count("*").alias("held")).filter(F.col("held") > HEAVY).select(*key, F.ceil(F.col("held") / HEAVY).cast("int").alias("shares"))
    dealt = rows.join(heavy, key, "left").withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("salt", F.explode(F.expr("sequence(0, shares - 1)")))
    dealt = dealt.select(*key, "salt", "word", "n", (F.pmod(F.xxhash64("word"), F.col("shares")) == F.col("salt")).alias("asks"))
    ordered = dealt.repartition(*key, "salt").sortWithinPartitions(*key, "salt", F.desc("n"), "word")
    answers = arrow_map(ordered, _walk, "word string, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    everything = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n")).unionByName(answers.withColumn("n", F.lit(None).cast("long")))
    met = everything.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return met.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by pointer doubling.

    Counts double along a chain, so it has no circle and at most 63 steps: seven rounds. A root that many words point at
    has no form of its own, so it is left out before words look up what they point at."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("root").alias("word")).distinct().join(now, "word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(further, "further")
        if further.isEmpty():
            return now
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, letters: int = LETTERS, least: int = COUNT, times: int = 2, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents. A word's form is its most counted near word, if
    that is counted at least `times` as often; its root is the last form that forms lead to."""
    with scratch(docs.sparkSession) as keep:
        vocabulary = stored(words(docs, letters, least, change), "vocabulary")
        met = near_words(vocabulary, letters)
        formed = F.col("form_n") >= times * F.col("n")
        met = stored(met.select("word", "n", "n_near", F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "near")
        roots = _roots(met.filter("form IS NOT NULL"))
        out = stored(met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
        keep.append(out)
        return out
