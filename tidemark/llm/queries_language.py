"""Queries of operators 2, 3 and 7."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.language_id import identify, train
from tidemark.llm.sentencepiece_scan import encode
from tidemark.llm.token_counts import token_counts

MODEL = "piece_bpe_32k.model"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)
    trained = train(docs.filter(~held_out()), model)
    return identify(docs.select("doc_id", "text"), trained, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)).select("doc_id", "n_chars", "n_tokens", "ids", "decodes")


QUERIES = {"op2_token_counts": op2_token_counts, "op3_language_id": op3_language_id, "op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
