"""SentencePiece encoding and decoding by a max-plus parallel scan (operator 7).

A segmentation is the best path through the pieces of a text: for a BPE model the one path whose neighbours fit
(`merge_rule`: value 0, all others minus infinity), so that the ids are those of the library; for a unigram model the
path of the highest sum of piece scores (`unigram_rule`). Characters in no piece become bytes. Pieces never span a
space, so words are independent and each distinct one is solved once. Giant documents are cut into chunks of fixed
length wherever that falls: a chunk yields the max-plus matrix from the states at its start to those at its end, the
matrices of a document are combined associatively in blocks, and each chunk is then traced back by itself from the
states at its two ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, freed, small_batches, stored, text_slices, with_fields
from tidemark.llm.merge_rule import Chains, MergeCoder
from tidemark.llm.pieces import SPACE, vocabulary
from tidemark.llm.unigram_rule import Coder, Sums

#: Documents of more characters are cut into chunks of so many; so many chunks make a block of the scan.
GIANT, CHUNK, BLOCK = 32_768, 8192, 64
#: A worker encodes about so many characters together, and traces so many chunks: several workers share an executor's memory.
TOGETHER, TRACED = 1 << 18, 32


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The unigram rule with a model's pieces and scores."""
    return Coder(path)


@lru_cache(maxsize=2)
def merge_coder(path: str) -> MergeCoder:
    """The merge rule with a model's pieces and ranks."""
    return MergeCoder(path)


def rule_of(path: str) -> str:
    """`bpe` or `unigram`, as a model file says."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = {1: "unigram", 2: "bpe"}
    if proto.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and BPE models")
    return kinds[proto.trainer_spec.model_type]


def _scan(chunks: DataFrame, algebra: Sums | Chains) -> DataFrame:
    """(key, chunk, entry, leave) of every chunk, by blocks: combine, pass along the blocks, pass within each."""
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("chunk"), None
        for m in pdf["matrix"]:
            out = algebra.load(m) if out is None else algebra.combine(out, algebra.load(m))
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "matrix": [out.tobytes()]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        s = algebra.states([algebra.load(m) for m in pdf["matrix"]], 0, 0)
        return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "begin": s[:-1], "finish": s[1:]})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        s = algebra.states([algebra.load(m) for m in pdf["matrix"]], int(pdf["begin"].iloc[0]), int(pdf["finish"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "entry": s[:-1], "leave": s[1:]})

    blocks = chunks.select("key", "block", "chunk", "matrix")
    ends = blocks.groupBy("key", "block").applyInPandas(combine, "key long, block long, matrix binary").groupBy("key").applyInPandas(along, "key long, block long, begin int, finish int")
    return blocks.join(ends, ["key", "block"]).groupBy("key", "block").applyInPandas(within, "key long, chunk long, entry int, leave int")


def lists_of(n: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    """Lists of n ids each from the ids end to end."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))


def encoded(own: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_chars, n_tokens, ids, decodes) of batches of (id, text, n_chars), a few texts at a time."""
    for batch in batches:
        for part, texts in text_slices([batch], most=TOGETHER):
            n, ids = own.encode(texts)
            good = own.gives_back(n, ids, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), lists_of(n, ids), pa.array(good)], ["id", "n_chars", "n_tokens", "ids", "decodes"])
        freed()


def traced_chunks(own: Coder, algebra: Sums | Chains, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, n_chars, chunk, ids, decodes) of batches of chunks with the states at their ends, a few chunks at a time."""
    names = ["id", "key", "n_chars", "chunk"]
    for batch in batches:
        for at in range(0, batch.num_rows, TRACED):
            few, ids, good = batch.slice(at, TRACED), [], []
            for before, part, inside, entry, leave in zip(*(few.column(c).to_pylist() for c in ("before", "part", "inside", "entry", "leave"))):
                ids.append(own.trace(before, part, inside, entry, leave))
                covered = own.raw(ids[-1]).tobytes()
                good.append(covered == part[algebra.covered(entry) : inside + algebra.covered(leave)].encode("utf-8", "surrogatepass"))
            lists = lists_of(np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([*(few.column(c) for c in names), lists, pa.array(good, pa.bool_())], [*names, "ids", "decodes"])
        freed()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK, rule: str | None = None) -> DataFrame:
    """(id, n_chars, n_tokens, ids, decodes) of each document.

    Null and empty texts have no ids. The mark U+2581 in a text is the same as a space, as in the library; `decodes`
    tells that the ids give the text back otherwise. Ids of documents may be null or repeated: rows stay one to one.
    rule: `bpe` or `unigram`; the model's own by default. By the unigram rule, of equal paths the one whose last piece
    is longest wins; by the merge rule there is one path. Columns besides the two are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    longest = vocabulary(model).longest
    chunk = max(chunk, 2 * longest)
    made = {"bpe": merge_coder, "unigram": coder}[rule or rule_of(model)]
    algebra = Chains(longest) if made is merge_coder else Sums(longest)
    size = F.coalesce(F.length(text_col), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.cast("long").alias("n_chars"))
    result = f"id {kind}, n_chars long, n_tokens long, ids array<int>, decodes boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(made(model), batches)

    small = arrow_map(rows.filter(size <= giant), whole, result)
    large = rows.withColumn("key", F.monotonically_increasing_id()).filter(size > giant)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(model)
        for batch in batches:
            for doc, text, n, key in zip(*(c.to_pylist() for c in batch.columns)):
                text = SPACE + text.replace(" ", SPACE)
                last = max(1, len(text) // chunk) - 1
                for k in range(last + 1):
                    part = text[k * chunk :] if k == last else text[k * chunk : (k + 1) * chunk + longest - 1]
                    inside = len(part) if k == last else chunk
                    before = text[max(0, k * chunk - longest) : k * chunk]
                    yield pa.RecordBatch.from_pydict({"id": pa.array([doc], batch.schema.field(0).type), "key": [key], "n_chars": [n], "chunk": [k], "block": [k // BLOCK], "before": [before], "part": [part], "inside": [inside], "matrix": [own.matrix(before, part, inside, k == 0).tobytes()]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from traced_chunks(made(model), algebra, batches)

    chunks = stored(arrow_map(large, cut, f"id {kind}, key long, n_chars long, chunk long, block long, before string, part string, inside long, matrix binary"), "chunks")
    joined = chunks.drop("matrix", "block").join(_scan(chunks, algebra), ["key", "chunk"])
    each = arrow_map(joined, trace, f"id {kind}, key long, n_chars long, chunk long, ids array<int>, decodes boolean")
    back = each.groupBy("key").agg(F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"), F.min("decodes").alias("decodes"))
    ids = F.flatten(F.col("parts.ids"))
    big = back.select("id", "n_chars", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), "decodes")
    return small.unionByName(big).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The frame with the text of its ids (null: empty) in `text_col`; the other columns stay."""
    small_batches(encoded.sparkSession)
    kept = encoded.drop(text_col) if text_col != ids_col else encoded
    place = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return arrow_map(kept, run, with_fields(kept, **{text_col: "string"}))
