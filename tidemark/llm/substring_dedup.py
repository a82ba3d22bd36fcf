"""Removal of passages that stand earlier in the corpus, by Rabin-Karp hashes of every window of words.

A word is a run of other bytes than space and \\t to \\r. Every window of `window` consecutive words of one document has
a rolling hash of 64 bits and another of 16 that must agree too (80 bits in all: two different windows count as equal
with a chance of 1e-24 a pair). The hashes are dealt by ranges to tasks, which count them; of the windows with equal
hashes the first stays (smallest doc_id, then smallest start) and the words of all others go. Overlapping and touching
windows merge into maximal intervals.

Before hashes leave a task, equal ones among a million windows are told apart there, so that a passage, line or copy
that a third of all documents share reaches its range once for each million windows. A range's size is bounded by the
number of ranges, which follows the corpus.

Defined cases: a null or empty text has no words and nothing is removed; a document of fewer words than a window loses
nothing. A null doc_id comes before all others. Rows that share a doc_id (or have none) are told apart by their texts,
in the order of a hash of the text; rows equal in both are one document, and each of them gets its result. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, ragged, scratch, small_batches, stored, text_slices, with_fields

#: Words of a window, unless a caller says otherwise.
WINDOW = 20
#: Windows that a task compares before it sends them, and windows of a range on average.
TOGETHER, RANGE = 1 << 20, 1 << 22
#: Fixed odd multipliers of the rolling hashes (letters, words, check), and their inverses modulo 2^64.
LETTERS, WORDS, CHECK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: What stands between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

HASHES = "bucket int, hashes binary, checks binary, ids binary, ties binary, bases binary, counts binary, gaps binary, gone_ids binary, gone_ties binary, gone_starts binary"
GONE = "part int, ids binary, ties binary, starts binary"
INTERVALS = "id long, tie long, starts array<int>, ends array<int>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum of values[i] * base^(i - start) over each range, modulo 2^64: prefix sums give any range at once."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), n + 1)[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the finishing step of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of all words of the texts, how many each text has)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    tops = np.cumsum(lengths + 1)
    counts = np.diff(np.searchsorted(starts, tops, side="left"), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    return _mixed(_rolled(BYTES[data], starts, ends, LETTERS) + (ends - starts).astype(np.uint64)), counts


def windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, number of the text, start) of every window of the texts."""
    words, counts = word_hashes(texts)
    firsts = np.cumsum(counts) - counts
    many = np.maximum(counts - window + 1, 0)
    at = ragged(firsts, many)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint16), none, none
    hashes = _mixed(_rolled(words, at, at + window, WORDS))
    checks = (_rolled(_mixed(words), at, at + window, CHECK) >> np.uint64(48)).astype(np.uint16)
    owner = np.repeat(np.arange(len(texts)), many)
    return hashes, checks, owner, at - firsts[owner]


def _later(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether an equal window stands before each window, by (id, tie, start)."""
    out = np.zeros(len(hashes), bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return out
    met = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    met = met[np.lexsort((starts[met], ties[met], ids[met], checks[met], hashes[met]))]
    again = np.concatenate(([False], (hashes[met[1:]] == hashes[met[:-1]]) & (checks[met[1:]] == checks[met[:-1]])))
    first = met[np.maximum.accumulate(np.where(again, 0, np.arange(len(met))))]  # of the windows equal to each
    out[met] = (ids[met] != ids[first]) | (ties[met] != ties[first]) | (starts[met] != starts[first])  # a repeated row is the same place
    return out


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """About TOGETHER windows at a time: (hash, check, id, tie, start) of each."""
    held: list[tuple[np.ndarray, ...]] = []
    for part, texts in text_slices(batches, 2, 1 << 21):
        ids, ties = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        hashes, checks, owner, starts = windows([t.encode() for t in texts], window)
        held.append((hashes, checks, ids[owner], ties[owner], starts))
        if sum(len(h[0]) for h in held) >= TOGETHER:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _packed(schema: str, bucket: int, *arrays: np.ndarray) -> dict:
    names = [c.split()[0] for c in schema.split(", ")]
    return dict(zip(names, (bucket, *(a.tobytes() for a in arrays))))


def _deal(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, checks, ids, ties, starts in _texts(batches, window):
            gone = _later(hashes, checks, ids, ties, starts)
            bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                mine = order[edges[b] : edges[b + 1]]
                left, here = mine[gone[mine]], mine[~gone[mine]]
                # Windows of a document follow each other with gaps of a byte; a wider one begins a new run.
                step = np.diff(starts[here], prepend=-1)
                begins = (np.diff(ids[here], prepend=0) != 0) | (np.diff(ties[here], prepend=0) != 0) | (step > 255) | (step < 0)
                begins[:1] = True
                heads = here[begins]
                runs = np.diff(np.flatnonzero(np.concatenate((begins, [True])))).astype(np.int32)
                gaps = np.where(begins, 0, step).astype(np.uint8)
                rows.append(_packed(HASHES, int(b), hashes[here], checks[here], ids[heads], ties[heads], starts[heads].astype(np.int32), runs, gaps, ids[left], ties[left], starts[left].astype(np.int32)))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[k : k + 64], schema=_ARROW[HASHES])

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


_ARROW = {k: _arrow(k) for k in (HASHES, GONE, INTERVALS)}


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _count(parts: int):
    """Of one range of hashes: the windows that are not the first of their kind, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        hashes, checks = _joined(table, "hashes", np.uint64), _joined(table, "checks", np.uint16)
        runs, gaps = _joined(table, "counts", np.int32).astype(np.int64), _joined(table, "gaps", np.uint8).astype(np.int64)
        ids, ties = (np.repeat(_joined(table, c, np.int64), runs) for c in ("ids", "ties"))
        along = np.cumsum(gaps)
        heads = np.cumsum(runs) - runs
        starts = np.repeat(_joined(table, "bases", np.int32) - along[heads], runs) + along
        gone = _later(hashes, checks, ids, ties, starts)
        ids, ties, starts = (np.concatenate((a[gone], _joined(table, f"gone_{c}", k))) for a, c, k in ((ids, "ids", np.int64), (ties, "ties", np.int64), (starts, "starts", np.int32)))
        part = (_mixed(ids.astype(np.uint64) ^ _mixed(ties.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [_packed(GONE, int(p), ids[m], ties[m], starts[m].astype(np.int32)) for p in np.flatnonzero(np.diff(edges)) for m in [order[edges[p] : edges[p + 1]]]]
        return pa.Table.from_pylist(rows, schema=_ARROW[GONE])

    return run


def _merge(window: int):
    """Of one part of the documents: maximal intervals of words that go."""

    def run(table: pa.Table) -> pa.Table:
        ids, ties, starts = _joined(table, "ids", np.int64), _joined(table, "ties", np.int64), _joined(table, "starts", np.int32)
        order = np.lexsort((starts, ties, ids))
        ids, ties, starts = ids[order], ties[order], starts[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])))
        begins = np.flatnonzero(new | np.concatenate(([True], starts[1:] > starts[:-1] + window)))
        lows, highs = starts[begins], starts[np.concatenate((begins[1:], [len(starts)])) - 1] + window
        docs = np.flatnonzero(new[begins])
        offsets = pa.array(np.concatenate((docs, [len(begins)])).astype(np.int32))
        columns = [pa.array(ids[begins[docs]]), pa.array(ties[begins[docs]]), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (lows, highs))]
        return pa.Table.from_arrays(columns, schema=_ARROW[INTERVALS])

    return run


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """What tells a row from others, in order: its id (none: the least), then a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")


def intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, tie, starts, ends): the maximal intervals of word places that go, of each document that loses any."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*_key(docs), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word has about seven bytes with its space; so many ranges keep one near RANGE windows.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (7 * RANGE) + 1)
    dealt = arrow_map(rows, _deal(window, buckets), HASHES)
    gone = dealt.groupBy("bucket").applyInArrow(_count(buckets), GONE)
    return gone.groupBy("part").applyInArrow(_merge(window), INTERVALS)


def _kept(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, at):
            starts, ends = part.column("_starts").to_pylist(), part.column("_ends").to_pylist()
            many, removed, kept = [], [], []
            for text, lows, highs in zip(texts, starts, ends):
                words = text.encode().split()
                many.append(len(words))
                removed.append(sum(highs) - sum(lows) if lows else 0)
                for low, high in zip(reversed(lows or []), reversed(highs or [])):
                    del words[low:high]
                kept.append(b" ".join(words).decode())
            columns = [c for n, c in zip(part.schema.names, part.columns) if n not in ("_starts", "_ends", "_text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*(n for n in part.schema.names if n not in ("_starts", "_ends", "_text")), "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row: the words that stay, joined by one space."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        gone = stored(intervals(docs, window), "intervals")
        keep.append(gone)
        id_, tie = _key(docs)
        rows = docs.select("doc_id", F.col("text").alias("_text"), id_, tie).join(gone, ["id", "tie"], "left")
        rows = rows.select("doc_id", "_text", F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
        return arrow_map(rows, _kept(1), with_fields(docs.select("doc_id"), n_words="long", n_removed="long", kept="string"))
