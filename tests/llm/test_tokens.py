"""Operators 2, 3, 4 and 7 against the libraries."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from tidemark.llm import language_id, sentencepiece_scan, token_counts, token_store
from tidemark.llm.words import WordLists

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "  a  b ", "a\n\nb \n c", "▁x▁", "<s> </s> <unk>", "aaaa" * 500, "é漢字😀", "tab\there", "x" * 3000, "a b\nc d", "<|endoftext|> it's 's 12 3²"]


def texts(n: int = 300) -> list:
    rng = random.Random(4)
    parts = ["the ", "and", " ", "\n", "ing", "漢", "é", "1", ".", "!!", "###", "\t", "Thnt", "  "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 50 else None, t, "en", "clash") for i, t in enumerate(texts(), 1)] + [(7, "repeated id", None, None), (7, "repeated id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string").repartition(5).cache()


def test_token_counts(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(docs, MODEL, limit=10).collect()
    assert len(got) == docs.count()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_merges_that_bring_better_pairs():
    merger = token_counts.Merger(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinorst") for _ in range(k)) for k in (0, 1, 2, 60, 400, 3000)]
    assert merger.counts(["▁" + w for w in words]).tolist() == [len(sp.encode(w)) if w else 1 for w in words]


def test_token_store(docs):
    segments = token_store.write(docs, BYTES, 2, parts=4)
    got = token_store.read(segments).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    # Rows of one id may stand in any order; starts and sums of all must agree.
    assert sorted(map(str, ((g.id, g.n_tokens, g.ids_crc32) for g in got))) == sorted(map(str, ((w[0], *w[2:]) for w in want)))
    assert sorted(g.start for g in got)[0] == 0 and max(g.start + g.n_tokens for g in got) == at
    flat = [i for r in rows for i in tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]]
    assert all(0 <= g.first_id and 0 <= g.middle_id for g in got) and sorted(g.first_id for g in got) == sorted(flat[w[1]] for w in want)
    asked = docs.sparkSession.createDataFrame([(0,), (at - 1,), (at,), (at // 2,), (None,), (0,)], "place long")
    by_id = {r.doc_id for r in rows if [x.doc_id for x in rows].count(r.doc_id) > 1}
    for r in token_store.tokens_at(segments, asked).collect():
        if r.place is None or r.place >= at:
            assert r.token is None
        else:
            holder = max((g for g in got if g.start <= r.place), key=lambda g: g.start)
            assert holder.id in by_id or r.token == flat[r.place]
    order = [g.id for g in sorted(got, key=lambda g: g.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("most", [2, 200, 70_000, 2**32 - 1])
def test_codes_round_trip_and_random_access(n, most):
    ids = np.random.default_rng(n).integers(0, most, n)
    data = token_store.pack(ids)
    assert token_store.unpack(data).tolist() == ids.tolist()
    places = np.arange(n)[::-1]
    assert token_store.access(data, places).tolist() == ids[places].tolist()


def test_sentencepiece_paths_are_best():
    """The best sum by a plain search over all segmentations, and never below the library's unigram mode."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = sentencepiece_scan.coder(MODEL)
    rng = random.Random(2)
    plain = ["".join(rng.choice(["the ", "and", "ing", "er", "th", " on", "x", "'s", "."]) for _ in range(20)) for _ in range(200)]
    n, ids = own.encode(plain)
    at = np.r_[0, np.cumsum(n)]
    for k, t in enumerate(plain):
        mark = "▁" + t.replace(" ", "▁")
        best = [0.0]
        for to in range(1, len(mark) + 1):
            best.append(max(best[a] + own.score[own.vocab.ids[mark[a:to]]] for a in range(max(0, to - 16), to) if mark[a:to] in own.vocab.ids))
        mine = own.score[ids[at[k] : at[k + 1]]].sum()
        assert mine == best[-1] >= own.score[sp.encode(t)].sum()


def test_sentencepiece_chunks_and_round_trip(docs):
    own = sentencepiece_scan.coder(MODEL)
    whole = sentencepiece_scan.encode(docs, MODEL).collect()
    cut = sentencepiece_scan.encode(docs, MODEL, giant=50, chunk=40)
    parts = cut.collect()
    assert len(whole) == len(parts) == docs.count() and all(r.decodes for r in whole + parts)
    score = lambda rows: sorted((str(r.doc_id), r.n_chars, round(float(own.score[list(r.ids)].sum()), 3)) for r in rows)
    assert score(whole) == score(parts)  # other paths may be as good, none better
    back = sentencepiece_scan.decode(cut, MODEL).select("text").collect()
    assert sorted(r.text for r in back) == sorted((r.text or "").replace("▁", " ") for r in docs.select("text").collect())


def test_sentencepiece_ids_are_the_librarys(docs):
    """Whole documents, and documents in chunks whose borders fall anywhere."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(r.doc_id), sp.encode(r.text or "")) for r in docs.collect())
    for given in ({}, {"giant": 50, "chunk": 40}):
        got = sentencepiece_scan.encode(docs, MODEL, **given).collect()
        assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
        assert all(r.n_tokens == len(r.ids) for r in got)


def test_sentencepiece_giant_documents(spark):
    """Texts over the size for chunks, with and without spaces, and over more chunks than a block of the scan holds."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    letters = "".join(rng.choice("aeinorst") for _ in range(40_000))
    words = " ".join(rng.choice(["the", "committee", "published", "figures", "é漢", "\n"]) for _ in range(120_000))
    given = [letters, "a" * 33_000, "\n " * 20_000, " " * 33_000, words]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece_scan.encode(docs, MODEL).collect()}
    assert all(list(got[k].ids) == sp.encode(t) and got[k].decodes for k, t in enumerate(given))


def test_sentencepiece_workers_hold_little(docs, monkeypatch):
    """A worker's own arrays and lists stay far below the batches that it may get, for whole texts and for chunks."""
    runs, real = [], sentencepiece_scan.arrow_map
    monkeypatch.setattr(sentencepiece_scan, "arrow_map", lambda df, run, schema: runs.append(run) or real(df, run, schema))
    sentencepiece_scan.encode(docs, MODEL)
    whole, cut, trace = runs
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    made = [" ".join(rng.choice(words) for _ in range(5000)) for _ in range(40)]
    sizes = [len(t) for t in made]
    texts_of = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": made, "n_chars": sizes})
    long = " ".join(made)
    given = pa.RecordBatch.from_pydict({"id": [1], "text": [long], "n_chars": [len(long)], "key": [1]})
    chunks = pa.Table.from_batches(cut(iter([given]))).combine_chunks()
    algebra = sentencepiece_scan.Chains(sentencepiece_scan.vocabulary(MODEL).longest)
    states = algebra.states([algebra.load(m) for m in chunks["matrix"].to_pylist()], 0, 0)
    ended = chunks.append_column("entry", pa.array(states[:-1], pa.int32())).append_column("leave", pa.array(states[1:], pa.int32())).combine_chunks()
    sp, got = sentencepiece.SentencePieceProcessor(model_file=MODEL), {}
    for name, run, batch in (("whole", whole, texts_of), ("trace", trace, ended.to_batches()[0])):
        ids = [i for part in run(iter([batch])) for own in part.column("ids").to_pylist() for i in own]
        assert ids == [i for t in (made if run is whole else [long]) for i in sp.encode(t)]
        tracemalloc.start()
        for part in run(iter([batch])):
            del part
        got[name] = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
    assert got["whole"] < 20 and got["trace"] < 6, got


def test_sentencepiece_unigram_rule_in_chunks(docs):
    """A unigram model's rule: whole and cut documents have paths of one score, that of the library's unigram mode or better."""
    own = sentencepiece_scan.coder(MODEL)
    score = lambda rows: sorted((str(r.doc_id), round(float(own.score[list(r.ids)].sum()), 3)) for r in rows)
    whole, cut = (sentencepiece_scan.encode(docs, MODEL, rule="unigram", **g).collect() for g in ({}, {"giant": 50, "chunk": 40}))
    assert score(whole) == score(cut) and all(r.decodes for r in whole + cut)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trained = language_id.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"), MODEL)
    got = language_id.identify(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), trained, MODEL).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "le chat est sur la table", "fr", "x"), (2, "the cat is on the table", "en", "x"), (3, None, "en", "x"), (4, "12 !?", None, "x"), (None, "the table", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.text: r.lang_pred for r in language_id.identify(docs, language_id.train(docs, MODEL), MODEL).collect()}
    assert got[None] == got["12 !?"] == "und" and got["the table"] == "en" and got["le chat est sur la table"] == "fr"
    none = language_id.identify(docs, language_id.train(docs.filter("false"), MODEL), MODEL)
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_marginals_sum_all_segmentations():
    vocab = sentencepiece_scan.vocabulary(MODEL)
    logs = np.log(np.random.default_rng(0).random((vocab.size, 2)) / 100)
    word = "▁then"

    def brute(at, k):
        if at == len(word):
            return 1.0
        return sum(np.exp(logs[vocab.ids[word[at:to]], k]) * brute(to, k) for to in range(at + 1, len(word) + 1) if word[at:to] in vocab.ids)

    got = language_id.marginals(vocab, [word, "▁a"], logs, -20.0)
    assert np.allclose(got[0], [np.log(brute(0, k)) for k in (0, 1)])


@pytest.mark.parametrize("run", [lambda d: token_counts.token_counts(d, MODEL), lambda d: token_store.read(token_store.write(d, BYTES, 2)), lambda d: sentencepiece_scan.encode(d, MODEL)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_full_table_of_words_keeps_those_asked_for_most():
    made = []

    def work(ws):
        made.extend(ws)
        return np.array([len(w) for w in ws]), np.array([ord(c) for w in ws for c in w], np.int64)

    held = WordLists("test of words", work, 40_000)
    often = [f"often{k}" for k in range(20)]
    for k in range(60):
        words = often + [f"rare{k}-{j}" for j in range(30)] + often[:: k % 3 + 1]
        n, at, flat = held.gather(words)
        assert ["".join(map(chr, flat[a : a + m])) for a, m in zip(at.tolist(), n.tolist())] == words
        assert held.held < 50_000
    assert len(made) == len(set(made)) == 20 + 60 * 30  # each word was worked out once: before, the often asked ones anew whenever the table was full
