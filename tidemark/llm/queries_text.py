"""Queries of operators 6, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, pii
from tidemark.llm.common import table
from tidemark.llm.decontaminate import find


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(pii.joined(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", *(pii.count_of(k).alias(f"n_{k}") for k in pii.BASE), base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def _shingles(name: str, key: str, k: str) -> str:
    """Distinct shingles of a table, as SQL; k is the number of words of a shingle, as SQL over the words w."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i+k-1], ' ') AS s
    FROM (SELECT {key}, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM (SELECT *, unnest({k}) AS k FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name} WHERE text IS NOT NULL AND {key} IS NOT NULL)) WHERE k > 0)"""


OP9_SQL = f"""
WITH item AS ({_shingles('benchmark', 'item_id', '[least(5, len(w))]')}),
     size AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
     doc AS ({_shingles('documents', 'doc_id', '[1, 2, 3, 4, 5]')})
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found, round(count(*)::DOUBLE / n, 6) AS containment
FROM doc JOIN item USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""

OP6_SQL = """
WITH RECURSIVE
     t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 4 THEN w[i:i+3] ELSE w END, ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.s = b.s JOIN n AS x ON a.doc_id = x.doc_id JOIN n AS y ON b.doc_id = y.doc_id
               WHERE 85 * greatest(x.n, y.n) <= 100 * least(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
     reach AS (SELECT doc_id AS a, doc_id AS r FROM t UNION SELECT l.b, r FROM reach JOIN links AS l ON reach.a = l.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id FROM t LEFT JOIN n ON t.doc_id = n.doc_id JOIN reach ON t.doc_id = reach.a GROUP BY t.doc_id, n.n
"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join, "op9_decontamination": op9_decontamination, "op10_personal_data": op10_personal_data}
ORACLES = {"op6_jaccard_join": OP6_SQL, "op9_decontamination": OP9_SQL}
