"""The queries of all operators of this subpackage, by name, and their SQL."""

from __future__ import annotations

from tidemark.llm import queries_language, queries_pages, queries_repeats, queries_store, queries_text

PARTS = (queries_language, queries_pages, queries_repeats, queries_store, queries_text)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
