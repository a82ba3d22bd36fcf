"""The pipeline against a brute-force version of its decisions."""

import public_tokenizers

import corpus_pipeline
from tests.llm.test_matching import base_spans, brute_components
from tidemark.llm import sentencepiece_scan


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(100_000, None, None, "x", 0), (100_001, "12 34", None, "x", 5), (100_003, "xqzjv kwpqx zzxqj vvkqw jxqzp qqxwz pzkxv", None, "x", 40), (100_002, "mail me: x@y.com now please and thank you", "en", "x", 41)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rows = {r.doc_id: r.text for r in docs.unionByName(extra).collect()}
    left = {i: t for i, t in rows.items() if t and any(map(str.isalpha, t)) and i != 100_003}
    first = {i for i, (_, root) in brute_components(list(left.items()), corpus_pipeline.WIDTH, corpus_pipeline.NUM).items() if root == i}
    from tidemark.llm.decontaminate import find

    dirty = {r.doc_id for r in find(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert set(got) == first - dirty
    own = sentencepiece_scan.coder(public_tokenizers.path(corpus_pipeline.MODEL))
    assert own.decode(got[100_002].ids) == "mail me: [EMAIL] now please and thank you"
    for i in list(got)[:50]:
        if not base_spans(rows[i]):
            assert own.decode(got[i].ids) == rows[i]


def test_one_of_each_component_stays(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(5, text, "a"), (5, text, "b"), (3, text + " more", "c"), (None, text, "d"), (None, "alone in the world of words", "e"), (None, "alone in the world of words", "f"), (9, None, "g"), (10, "", "h"), (5, "another text with that id", "i")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n string, _row int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    names = sorted(r.n for r in kept.collect())
    assert kept.columns == docs.columns and [n for n in names if n not in "ef"] == ["c", "g", "h", "i"] and len(names) == 5


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
