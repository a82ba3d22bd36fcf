"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Stages take and return documents with their columns (the last one returns token ids). A stage drops or changes only
what its operator decides on; all else passes as it is.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, language_id, pii, sentencepiece_scan
from tidemark.llm.common import shared_folder, table

MODEL = "piece_bpe_32k.model"
#: Least posterior of a document's language, and least mean log probability of a letter; prose has -2, rarely less than -4.
SURE, NOISE = 0.5, -6.0
#: Near-duplicates share this much of their shingles of five words.
WIDTH, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised. Those go that have no letter, whose best language is no more likely
    than the others together, or whose letters are as unlikely in it as noise. Null and empty texts go."""
    model = public_tokenizers.path(MODEL)
    found = language_id.identify(docs, language_id.train(docs, model), model, pred_col="_found", score_col="_how_sure", fit_col="_fit")
    return found.filter((F.col("_found") != "und") & (F.col("_how_sure") >= SURE) & (F.col("_fit") >= NOISE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest id. Documents without words
    stay; rows that share an id or have none are told apart by their texts."""
    return jaccard_join.representatives(docs, width=WIDTH, num=NUM, den=DEN)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids."""
    return sentencepiece_scan.encode(docs, public_tokenizers.path(MODEL)).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language id", language),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The language and tokenizing stages cannot be said in SQL; tests compare run() with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
