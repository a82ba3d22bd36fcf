"""Connected components of a graph given as links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) links; root is the smallest node that links reach.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its smallest neighbour, then
    each node's smaller ones are (large star, small star). A node's neighbours are never gathered: each step joins a
    node's links with one number, its smallest neighbour. Every round is written to the shared folder.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: b's larger neighbours a now link to the smallest of b and its neighbours.
        least = now.groupBy("a").agg(F.min("b").alias("m"))  # of each node that has smaller neighbours
        big = now.join(least.withColumnRenamed("a", "n"), F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b"))
        big = stored(big, "links")
        # Small star: a and its smaller neighbours link to the smallest of them.
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("x")).select("x.*").distinct()
        after = stored(small, "links")
        # A star is one whose centres have no smaller neighbour and whose other nodes have one neighbour only.
        ends = after.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        open_ = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)")
        if open_.isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = after
