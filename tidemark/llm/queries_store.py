"""Queries of operators 4 and 5."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.token_store import read, write
from tidemark.llm.vector_search import top_k

#: What stands after each document.
END = 2


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END)
    return read(segments).withColumnRenamed("id", "doc_id")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op4_token_store": op4_token_store, "op5_vector_search": op5_vector_search}
OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
     s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v AS a JOIN v AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.c) = len(b.c)),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op5_vector_search": OP5_SQL}
