"""Queries of operators 11, 12 and 13."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.prefix_trie import places, trie
from tidemark.llm.spelling_variants import variants
from tidemark.llm.substring_dedup import deduplicate


def rebuilt(turns: DataFrame) -> DataFrame:
    """Places as the query wants them: each conversation c begins with the first h turns of conversation c - c % 5, and
    goes on with its own after its first h; place 0 is for every conversation, also for one that is left without turns.
    One shuffle, by the conversation that is begun with; its family has at most nine members."""
    base, head = (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (lambda c: (F.crc32(c.cast("string").cast("binary")) % 9).cast("int"))
    family, own = Window.partitionBy("base"), Window.partitionBy("base", "conv_id")
    rows = turns.select("*", base).repartition("base").withColumn("n", F.count("*").over(own))
    rows = rows.withColumn("n_base", F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n"))).over(family), F.lit(0))).withColumn("all", F.collect_set("conv_id").over(family))
    first, place = F.col("conv_id") == F.col("base"), F.col("place")
    h, at = head(F.col("conv_id")), lambda c, p: F.struct(c.alias("conv_id"), p.cast("int").alias("place"), F.when(p > 0, F.col("t1")).otherwise(0).alias("t1"), F.when(p > 0, F.col("t2")).otherwise(0).alias("t2"), F.when(p > 0, F.col("n_bytes")).otherwise(0).alias("n_bytes"))
    mine = F.when(first, F.array(at(F.col("conv_id"), place))).when(place > h, F.array(at(F.col("conv_id"), place - h + F.least(h.cast("long"), F.col("n_base")))))
    lent = F.when(first & (place <= 8), F.transform(F.filter("all", lambda c: (c != F.col("base")) & (head(c) >= place)), lambda c: at(c, place)))
    root = F.when(place == 1, F.array(at(F.col("conv_id"), F.lit(0))))
    empty = F.array().cast("array<struct<conv_id:bigint,place:int,t1:bigint,t2:bigint,n_bytes:bigint>>")
    return rows.select(F.explode(F.concat(*(F.coalesce(x, empty) for x in (mine, lent, root)))).alias("r")).select("r.*")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(places(table(spark, sf_dir, "conversations"))))


def crc32_sql(octets: str) -> str:
    """The unsigned crc32 of a list of bytes, as SQL: one bit after the other, by the usual reversed polynomial."""
    bits = f"flatten(list_transform({octets}, lambda o: list_transform(range(8), lambda k: (o >> k) & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


OP11_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key, strlen(coalesce(text, '')) AS bytes
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, {crc32_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o) AS d),
     r AS (SELECT c.conv_id, 0 AS part, pos, key, bytes FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
           UNION ALL SELECT c.conv_id, 1, pos, key, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
     s AS (SELECT c.conv_id, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM c LEFT JOIN (SELECT conv_id, list(key ORDER BY part, pos) AS keys, list(bytes ORDER BY part, pos) AS sizes FROM r GROUP BY conv_id) AS l ON c.conv_id = l.conv_id),
     p AS (SELECT conv_id, d, sha256(array_to_string(keys[1:d], '/')) AS path, keys, sizes[d] AS bytes, d = len(keys) AS ended FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM s) AS u),
     n AS (SELECT path, d, any_value(keys) AS keys, coalesce(any_value(bytes), 0) AS bytes, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM p GROUP BY path, d),
     a AS (SELECT path, (n_convs - 1) * bytes AS own, unnest(list_transform(range(0, d + 1), lambda e: sha256(array_to_string(keys[1:e], '/')))) AS above FROM n),
     kids AS (SELECT sha256(array_to_string(keys[1:d-1], '/')) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
     sums AS (SELECT above AS path, sum(own) AS saved, count(*) FILTER (WHERE a.path NOT IN (SELECT path FROM kids)) AS n_leaves FROM a GROUP BY above)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sums ON n.path = sums.path LEFT JOIN kids ON n.path = kids.path LEFT JOIN n AS up ON n.d > 0 AND up.path = sha256(array_to_string(n.keys[1:n.d-1], '/'))
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
     k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM s),
     gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE nth > 1)),
     word AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM t)),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

def letter_lost(doc_id: int | None, word: str) -> str:
    """The word without one letter, for one in 97 of a document's words; without an id all stay as they are."""
    h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
    return word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), change=letter_lost)


OP13_SQL = f"""
WITH RECURSIVE
     r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
           FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents WHERE text IS NOT NULL) AS u GROUP BY 1, 2),
     h AS (SELECT run, n, {crc32_sql("list_transform(range(0, strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))")} AS h FROM (SELECT *, concat(doc_id, ':', run) AS s FROM r) AS k),
     v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) AS c
           WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v) AS u),
     pair AS MATERIALIZED (SELECT DISTINCT a.word AS a, b.word AS b FROM d AS a JOIN d AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
              UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
     near AS MATERIALIZED (SELECT a AS word, b AS form, v.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS nth FROM pair JOIN v ON b = v.word),
     f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN near ON v.word = near.word AND nth = 1),
     walk AS (SELECT word, word AS root FROM f UNION SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word AND f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON f.word = walk.word JOIN f AS top ON walk.root = top.word AND top.form IS NULL
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants, "op11_prefix_trie": op11_prefix_trie, "op12_substring_dedup": op12_substring_dedup}
ORACLES = {"op13_spelling_variants": OP13_SQL, "op11_prefix_trie": OP11_SQL, "op12_substring_dedup": OP12_SQL}
