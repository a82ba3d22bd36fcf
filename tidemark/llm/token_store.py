"""Token ids as directly addressable codes, written and read as files (operator 4).

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id with a bitmap of the ids that go
on; level 1 the next chunk of those, and so on. A directory of ranks over each bitmap finds an id's place in the next
level, so any id can be read without decoding others. A file is a Parquet table whose rows are segments: consecutive
documents of one partition of the id order, each segment with its documents' ids and lengths and its codes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, ragged, small_batches, stored, text_slices
from tidemark.llm.pieces import SPACE, split_words
from tidemark.llm.words import WordLists

MAGIC, BITS, BLOCK = b"DAC1", 8, 512
#: A segment is closed when it holds so many tokens; a longer document is a segment of its own.
SEGMENT = 1 << 18
#: New words that are encoded as one text.
TOGETHER = 500

_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The codes of ids of at most 32 bits."""
    levels, rest = [], np.asarray(ids).astype(np.uint32)
    while len(rest) or not levels:
        low, on = (rest & 0xFF).astype(np.uint8), rest >> BITS > 0
        bits = np.packbits(on, bitorder="little")
        ranks = np.r_[0, np.cumsum(np.add.reduceat(on.astype(np.int64), np.arange(0, len(on), BLOCK)))] if len(on) else np.zeros(1)
        levels.append((len(low), low.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        rest = rest[on] >> BITS
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(struct.pack("<Q", n) + low + bits + ranks for n, low, bits, ranks in levels)


def _levels(data: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if data[:4] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    out, at = [], 5
    for _ in range(data[4]):
        (n,) = struct.unpack_from("<Q", data, at)
        at += 8
        low = np.frombuffer(data, np.uint8, n, at)
        bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + n)
        ranks = np.frombuffer(data, "<u4", (n + BLOCK - 1) // BLOCK + 1, at + n + len(bits))
        at += n + len(bits) + 4 * len(ranks)
        out.append((low, bits, ranks))
    return out


def access(data: bytes, places: np.ndarray) -> np.ndarray:
    """The ids at some places, each found by ranks alone."""
    places = np.asarray(places, np.int64)
    out, who, at = np.zeros(len(places), np.int64), np.arange(len(places)), places.copy()
    for k, (low, bits, ranks) in enumerate(_levels(data)):
        out[who] |= low[at].astype(np.int64) << (BITS * k)
        on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        who, at = who[on], at[on]
        if not len(who):
            break
        first = at // BLOCK * (BLOCK // 8)  # whole bytes of the block before the place, and the bits before it
        inside = ragged(first, (at >> 3) - first)
        own = np.bincount(np.repeat(np.arange(len(at)), (at >> 3) - first), weights=_COUNT[bits[inside]], minlength=len(at)).astype(np.int64)
        own += _COUNT[bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)]
        at = ranks[at // BLOCK].astype(np.int64) + own
    return out


def unpack(data: bytes) -> np.ndarray:
    """All ids."""
    out = None
    for low, bits, _ in reversed(_levels(data)):
        own = low.astype(np.uint32)
        if out is not None:
            own[np.unpackbits(bits, count=len(low), bitorder="little") == 1] |= out << np.uint32(BITS)
        out = own
    return out


class Tokens:
    """Encodes texts with a tokenizer file; keeps the distinct words.

    A byte-level tokenizer's first cut always falls before a space that is followed by something else and around single
    line ends, so words are independent there. Texts with other white space runs or with special tokens go whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        cut = str(self.tokenizer.pre_tokenizer)
        self.by_word = "ByteLevel(" in cut and "add_prefix_space=False" in cut and "use_regex=True" in cut and self.tokenizer.normalizer is None
        #: Ids whose piece begins with a space, which the byte-level alphabet spells so.
        self.begins = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.begins[[i for piece, i in self.tokenizer.get_vocab().items() if piece[0] == "\u0120"]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.runs, self.marks = (WordLists("token store", f, most) for f, most in ((self._solve, 48 << 20), (self._solve_runs, 48 << 20), (self._solve_runs, 8 << 20)))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words. A run of letters and the marks after it are always cut apart, so each is kept by itself."""
        # A word of a text's beginning is marked by SPACE before it, and has no space before it.
        heads, tails = [], []
        for w in words:
            head = w.rstrip(_MARKS)
            bare = head[1:] if head[:1] in (SPACE, "\n") else head
            if bare.isalpha():
                tails.append(w[len(head) :])
            else:
                head = w
                tails.append("")
            heads.append(head[1:] if head[0] == SPACE else head if head[0] == "\n" else " " + head)
        n, at, flat = self.runs.gather(heads)
        n_tail, at_tail, flat_tail = self.marks.gather(tails)
        count = n + n_tail
        start, ids = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        ids[ragged(start, n)] = flat[ragged(at, n)]
        ids[ragged(start + n, n_tail)] = flat_tail[ragged(at_tail, n_tail)]
        return count, ids

    def _solve_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs. Those that are a space and letters go together as one text: each begins at an id with a space."""
        joint = np.array([k for k, r in enumerate(runs) if r[:1] == " " and r[1:].isalpha()], np.int64)
        rest = np.setdiff1d(np.arange(len(runs)), joint)
        texts = ["".join([runs[k] for k in joint[at : at + TOGETHER].tolist()]) for at in range(0, len(joint), TOGETHER)]
        own = np.fromiter(chain.from_iterable(self._encode(texts)), np.int64)
        begins = np.flatnonzero(self.begins[own])
        n = np.zeros(len(runs), np.int64)
        n[joint] = np.diff(np.r_[begins, len(own)])
        lists = self._encode([runs[k] for k in rest.tolist()])
        n[rest] = [len(x) for x in lists]
        at, ids = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
        ids[ragged(at[joint], n[joint])] = own
        ids[ragged(at[rest], n[rest])] = np.fromiter(chain.from_iterable(lists), np.int64)
        return n, ids

    def _plain(self, text: str) -> bool:
        if not text or not self.by_word or SPACE in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return False
        return not any(s in text for s in self.special) and not _odd_space(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text: how many, and all end to end."""
        plain = [self._plain(t) for t in texts]
        words = []
        for t, p in zip(texts, plain):
            if p:
                own = split_words(t)
                own[0] = SPACE + own[0]
                words.append(own)
            else:
                words.append([])
        n, starts, flat = self.words.gather([w for ws in words for w in ws])
        sums, ends = np.r_[0, np.cumsum(n)], np.cumsum([len(ws) for ws in words])
        count = sums[ends] - sums[np.r_[0, ends[:-1]]]
        ids = flat[ragged(starts, n)]
        if all(plain):
            return count, ids
        rest = [k for k, p in enumerate(plain) if not p]
        lists = dict(zip(rest, self._encode([texts[k] for k in rest])))
        at = np.cumsum(count) - count
        parts = [np.array(lists[k], np.int64) if k in lists else ids[at[k] : at[k] + count[k]] for k in range(len(texts))]
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)


#: Marks that the first cut always parts from letters before them: not the apostrophe, letters, digits or spaces.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: White space besides the space and the line end, by the tokenizers' rule or by Python's.
_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"


def _odd_space(text: str) -> bool:
    return any(c in text for c in _SPACES)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def write(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode the texts in ascending order of id and write the file; returns its segments, read again.

    A null text counts as empty: such documents hold the end id alone. Documents with a null id come first; equal ids
    stand next to each other. The order is made by ranges of ids, so no task holds more than its range, and a segment
    holds about SEGMENT tokens or one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = (ordered.repartitionByRange(parts, "id") if parts else ordered.repartitionByRange("id")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = tokens(tokenizer), TaskContext.get().partitionId()
        held, ids, lengths, size, segment, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            names = pa.chunked_array(held).combine_chunks()
            sizes = np.concatenate(lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (part, segment, first, len(flat))] + [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes, pa.int64())), pa.array([pack(flat)], pa.binary())],
                ["part", "segment", "first", "n_tokens", "ids", "lengths", "codes"],
            )

        for batch, texts in text_slices(batches):
            n, flat = own.encode(texts)
            flat = np.insert(flat, np.cumsum(n), end)
            n = n + 1
            at, ends = 0, np.cumsum(n)
            while at < len(n):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + SEGMENT - size, side="right")))
                held.append(batch.column(0).slice(at, to - at))
                ids.append(flat[before : ends[to - 1]])
                lengths.append(n[at:to])
                size += int(ends[to - 1]) - before
                at = to
                if size >= SEGMENT or at < len(n):
                    yield close()
                    first, segment, size = first + size, segment + 1, 0
                    held, ids, lengths = [], [], []
        if size:
            yield close()

    return stored(arrow_map(ordered, run, f"part long, segment long, first long, n_tokens long, ids array<{kind.simpleString()}>, lengths array<long>, codes binary"), "tokens")


def read(segments: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, first_id, middle_id) of every document, from the file.

    start: ids of all documents before it. first_id and middle_id stand at a document's first and middle place, and are
    read by their places alone; a document always has an id, its end. The sums of the parts that come before each part are as many as partitions.
    """
    spark = segments.sparkSession
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a partition
    before, base = 0, []
    for part, n in totals:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part long, base long")
    small_batches(spark)
    kind = segments.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n = batch.column(2)[k].values, batch.column(3)[k].values.to_numpy()
                data = unpack(batch.column(4)[k].as_py()).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(data[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                first, middle = np.split(access(batch.column(4)[k].as_py(), np.r_[ends - n, ends - n + n // 2]), 2)
                start = batch.column(0)[k].as_py() + batch.column(1)[k].as_py() + ends - n
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(first), pa.array(middle)], ["id", "start", "n_tokens", "ids_crc32", "first_id", "middle_id"])

    joined = segments.join(F.broadcast(bases), "part").select("base", "first", "ids", "lengths", "codes")
    return arrow_map(joined, run, f"id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long, first_id long, middle_id long")


def tokens_at(segments: DataFrame, places: DataFrame, place_col: str = "place") -> DataFrame:
    """The frame of places with the id that stands at each (`token`), counted over all documents from 0; null beyond the
    end and for null places. Only the segments that hold a place are read, and in them only the places' own codes."""
    spark = segments.sparkSession
    before, spans = 0, []
    for part, n in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row a partition
        spans.append((part, before, before + n))
        before += n
    by_part = F.broadcast(spark.createDataFrame(spans, "part long, low long, high long"))
    asked = places.select(F.col(place_col).alias("place")).filter("place is not null").distinct()
    asked = asked.join(by_part, (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select("part", "place", (F.col("place") - F.col("low")).alias("inside"))
    # A segment holds at least SEGMENT ids unless it is the last one of its partition or stands before a long document.
    own = segments.select("part", "segment", "first", (F.col("first") + F.col("n_tokens")).alias("last"))
    found = asked.join(own, (asked["part"] == own["part"]) & (F.col("inside") >= F.col("first")) & (F.col("inside") < F.col("last"))).select(own["part"], "segment", "place", (F.col("inside") - F.col("first")).alias("at"))
    wanted = found.groupBy("part", "segment").agg(F.collect_list("place").alias("place"), F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, at, codes in zip(*(batch.column(c) for c in ("place", "at", "codes"))):
                ids = access(codes.as_py(), at.values.to_numpy())
                yield pa.RecordBatch.from_arrays([place.values, pa.array(ids)], ["place", "token"])

    small_batches(spark)
    read_ = arrow_map(segments.join(wanted, ["part", "segment"]).select("place", "at", "codes"), run, "place long, token long")
    return places.join(read_.withColumnRenamed("place", place_col), place_col, "left")
