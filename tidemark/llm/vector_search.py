"""Exact top-k search with vector-approximation files (operator 5).

Vectors are stored in blocks; beside the exact vectors a block has an approximation, a few bits per component that name
a cell. For a query the cells of a block give an upper bound of every inner product. The exact vectors are then read
in the order of falling bounds, until no bound reaches the kth best score found: what is left cannot enter the result.
Blocks of queries meet blocks of vectors in tasks of bounded size, and each query's best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, small_batches, stored

#: Vectors and queries of a block, and bits of a component in the approximation.
BLOCK, QUERIES, BITS = 8192, 1024, 5
#: A component times 64 must be a 63-bit integer: beyond that no score is one of 64 bits.
LARGEST = 2.0**56
#: Exact vectors are read in steps of so many for each query at a time.
STEP = 64


class Approximation:
    """The cells of a block of integer vectors: equal widths between each component's least and greatest value."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        self.low = vectors.min(axis=0)
        self.width = np.maximum(1, -(-(vectors.max(axis=0) - self.low + 1) >> bits))
        self.cells = ((vectors - self.low) // self.width).astype(np.uint8 if bits <= 8 else np.int64)

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """[query, vector]: the greatest inner product with any vector of the cell."""
        low = self.low + self.cells * self.width  # the cell's least and greatest corner
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        out = up @ (low + self.width - 1).T.astype(float)
        out += down @ low.T.astype(float)
        return out


def nearest(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best vectors, itself left out; equal scores go to smaller ids."""
    bounds, out = Approximation(vectors).upper(queries), []
    slack = 1e-9 * (1 + np.abs(bounds).max(initial=0))  # of float arithmetic
    for bound, query, own in zip(bounds, queries, query_ids.tolist()):
        at, scores, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.inf
        while True:
            # The next exact vectors: those with the greatest bounds below what has been read.
            open_ = np.flatnonzero(bound < cut) if cut < np.inf else np.arange(len(bound))
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                open_ = open_[bound[open_] >= kth - slack]
                step = open_  # these are all that can still enter
            else:
                step = open_
                if len(open_) > STEP + k:
                    cut_now = np.partition(bound[open_], len(open_) - STEP - k)[len(open_) - STEP - k]
                    step = open_[bound[open_] >= cut_now]
            if not len(step):
                break
            cut = bound[step].min()
            step = step[ids[step] != own]
            at, scores = np.r_[at, step], np.r_[scores, vectors[step] @ query]
        best = np.lexsort((ids[at], -scores))[:k]
        out.append((ids[at[best]], scores[best]))
    return out


def cells(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component as doubles; null for a vector that is null or has a bad component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    return F.when(vec.isNotNull() & (F.size(vec) > 0) & fine, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score) of each query's k highest integer inner products; all, if there are fewer.

    Vectors that are null, empty, or have a component that is null, not finite or beyond LARGEST take no part, nor do rows
    with a null id. A query is compared with the vectors of its own length, except rows with its own id. Repeated
    vectors under other ids are all returned; rows that repeat an id count as separate vectors. Sums beyond 64 bits
    are not supported.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        """Rows (dim, block, ids, flat, wide) of `size` vectors each, as they come in each partition."""
        rows = df.select(F.col(id_col).cast("long").alias("id"), cells(F.col(vec_col), scale).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held: dict[int, tuple[list, list]] = {}
            part, made = TaskContext.get().partitionId(), 0

            def close(dim: int) -> pa.RecordBatch:
                nonlocal made
                ids, flat = (np.concatenate(x) for x in held.pop(dim))
                made += 1
                wide = bool(np.abs(flat).max() > 32767)
                return pa.RecordBatch.from_pydict({"dim": [dim], "block": [(part << 32) + made], "ids": [ids.tobytes()], "flat": [flat.tobytes() if wide else flat.astype(np.int16).tobytes()], "wide": [wide]})

            for batch in batches:
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                n = lists.value_lengths().to_numpy()
                flat = lists.flatten().to_numpy()
                starts = np.cumsum(n) - n
                for dim in np.unique(n).tolist():
                    own = np.flatnonzero(n == dim)
                    for at in range(0, len(own), size):
                        some = own[at : at + size]
                        a, b = held.setdefault(dim, ([], []))
                        a.append(ids[some])
                        b.append(flat[(starts[some][:, None] + np.arange(dim)).ravel()])
                        if sum(map(len, a)) >= size:
                            yield close(dim)
            for dim in list(held):
                yield close(dim)

        return stored(arrow_map(rows, pack, "dim long, block long, ids binary, flat binary, wide boolean"), name)

    vector_blocks = blocks(vectors, BLOCK, "vectors")
    query_blocks = blocks(queries, QUERIES, "queries")
    # Every block of queries meets every block of vectors of its length: the pairs are numbers, made on both sides.
    names = lambda df, c: df.groupBy("dim").agg(F.collect_list("block").alias(c))
    left = query_blocks.join(names(vector_blocks, "others"), "dim").select("dim", F.col("block").alias("qb"), F.explode("others").alias("vb"), "ids", "flat", "wide")
    right = vector_blocks.join(names(query_blocks, "others"), "dim").select("dim", F.explode("others").alias("qb"), F.col("block").alias("vb"), "ids", "flat", "wide")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        query_ids, ids = (np.frombuffer(x["ids"].iloc[0], np.int64) for x in (left, right))
        q, v = (np.frombuffer(x["flat"].iloc[0], np.int64 if x["wide"].iloc[0] else np.int16).reshape(len(i), -1).astype(np.int64) for x, i in ((left, query_ids), (right, ids)))
        found = []
        for at in range(0, len(q), 128):
            found += nearest(v, ids, q[at : at + 128], query_ids[at : at + 128], k)
        n = [len(i) for i, _ in found]
        return pd.DataFrame({"query_id": np.repeat(query_ids, n), "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    near = left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInPandas(meet, "query_id long, id long, score long")
    # A window with a bound on the row number keeps k rows of a query in each task before the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
