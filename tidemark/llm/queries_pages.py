"""Queries of operators 1 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.html_extract import extract, train
from tidemark.llm.license_scan import scan


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), train(pages))


QUERIES = {"op1_license_scan": op1_license_scan, "op8_html_text": op8_html_text}
ORACLES: dict[str, str] = {}
