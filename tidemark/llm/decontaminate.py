"""Benchmark decontamination by size-partitioned MinHash containment search (operator 9).

Only DataFrame functions. A test item is found in a document if the document holds at least `threshold` of the item's
distinct shingles of five words; a shorter item is one shingle of all its words. Items are partitioned by size; an item of n shingles is known by its floor((1 -
threshold) * n) + 1 smallest hashes, at least MINIMA of them: a document that holds enough of the item cannot miss all
of those, so the search loses nothing however long the document is. Pairs that share a minimum are verified by
counting the item's exact shingles in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WORDS, THRESHOLD, MINIMA = 5, 0.8, 4
#: Sizes of items in a partition grow by this factor; each partition has its own number of minima.
GROWTH = 2.0
#: Items' hashes are broadcast up to this many rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingles(w: Column, k: int = WORDS) -> Column:
    """Hashes of all runs of k words, in order; empty if there are fewer words. Runs of other lengths have other hashes."""
    at = F.sequence(F.lit(1), F.size(w) - (k - 1))
    return F.when(F.size(w) >= k, F.transform(at, lambda i: F.xxhash64(*(F.element_at(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc id, item id, n_shingles, n_found, containment) of each item found in each document.

    Null and empty texts, and items without words, hold nothing. An item of fewer than five words is found where its
    words stand in a row. Repeated documents are each
    reported; a repeated item id is taken as one item with the shingles of all its rows. Rows with a null id of their
    own take no part. Whole documents are searched.
    """
    item_words = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w"))
    # Lengths of the items that are one shingle each: WORDS - 1 numbers at most.
    short = [r[0] for r in item_words.select(F.size("w").alias("n")).filter(F.col("n").between(1, WORDS - 1)).distinct().collect()]
    own_shingles = lambda w: F.concat(shingles(w), *(shingles(w, k) for k in sorted(short)))
    of_item = F.coalesce(*(F.when(F.size("w") == k, shingles(F.col("w"), k)) for k in short), shingles(F.col("w")))
    item_sets = (
        item_words.select("item", F.explode(of_item).alias("h"))
        .groupBy("item").agg(F.sort_array(F.collect_set("h")).alias("set"))
        .withColumn("n", F.size("set"))
        # The partition of an item: sizes from GROWTH^k on, below GROWTH^(k+1). All of one have the largest one's minima.
        .withColumn("partition", F.floor(F.log(GROWTH, F.col("n").cast("double"))))
    )
    largest = item_sets.groupBy("partition").agg(F.max("n").alias("most"))
    sized = item_sets.join(F.broadcast(largest), "partition")  # one row for each power of GROWTH
    minima = F.greatest(F.lit(MINIMA), F.floor((1 - threshold) * F.col("most") + 1e-9).cast("int") + 1)
    sized = sized.withColumn("minima", F.slice("set", 1, minima)).select("item", "n", "set", "minima")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # bounds what is broadcast
    known = sized.select("item", F.explode("minima").alias("h"))
    every = sized.select("item", "n", F.explode("set").alias("h"))

    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w"))
    # Candidates: a hash of the document is among an item's minima. A document's own hits are counted before they move.
    seen = own.select("doc", F.explode(own_shingles(F.col("w"))).alias("h"))
    pairs = seen.join(_small(known, total), "h").select("doc", "item").distinct()
    # Verification: the same documents again, against all shingles of their candidates only.
    pairs = stored(pairs.groupBy("doc").agg(F.collect_set("item").alias("items")), "candidates")
    hit = own.join(_small(pairs, pairs.count()), "doc")  # few documents hold any item: the others aren't moved
    again = hit.select("doc", "items", F.explode(F.array_distinct(own_shingles(F.col("w")))).alias("h"))
    found = again.join(_small(every, total), "h").filter(F.array_contains("items", F.col("item")))
    counted = found.groupBy("doc", "item", "n").agg(F.count_distinct("h").alias("n_found"))
    kept = counted.filter(F.col("n_found") >= F.ceil(threshold * F.col("n") - 1e-9))
    return kept.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("n").cast("long").alias("n_shingles"), "n_found", F.round(F.col("n_found") / F.col("n"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no item is found, with all their columns.

    Each row is judged by its own text, whether its id is null or another row has it too; id_col only names the id.
    """
    row = "_row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # a number must not change when it is read again
    found = find(numbered, items, row, text_col, **options).select(row).distinct()
    return numbered.join(found, row, "left_anti").select(docs.columns)
