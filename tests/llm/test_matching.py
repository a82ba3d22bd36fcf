"""Operators 1, 5, 6, 8, 9 and 10 against brute force."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.llm import decontaminate, html_extract, html_pages, jaccard_join, license_scan, license_texts, pii, vector_search


def test_license_notices_and_texts(spark):
    rows = [(1, "prose. Released under the MIT License. more"), (2, license_texts.TEXTS["Apache-2.0"]), (3, None), (4, ""), (5, "a driving licence, version 3"), (None, "Licensed under CC BY-NC 4.0."), (6, license_texts.TEXTS["ISC"].replace("any purpose", "every purpose"))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.kind, r.exact) for r in got) == [
        ("1", "MIT", "notice", False), ("2", "Apache-2.0", "text", True), ("6", "ISC", "text", False), ("None", "CC-BY-NC-4.0", "notice", True)]
    assert {r.doc_id: rows[0][1][r.start : r.end] for r in got if r.doc_id == 1} == {1: "Released under the MIT License"}


def test_every_wording_is_found():
    for name, text in license_texts.TEXTS.items():
        assert [h[0] for h in license_scan.scan_text("Some words. " + text + " And more.")] == [name]
    for name, text in license_texts.NAMES.items():
        assert [h[0] for h in license_scan.scan_text(f"This work is licensed under the {text}. And more.")] == [name]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(30)]  # ties
    bad = [(900, None), (920, [None] * 16), (940, [float("nan")] * 16), (None, vectors[1][1]), (960, []), (980, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").repartition(7)
    got = vector_search.top_k(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    ids, x = np.array([v[0] for v in vectors]), np.floor(np.array([v[1] for v in vectors]) * 64).astype(int)
    want = []
    for q in ids[ids % 20 == 0]:
        s, m = x @ x[list(ids).index(q)], ids != q
        o = np.lexsort((ids[m], -s[m]))[:20]
        want += [(q, r, i, v) for r, (i, v) in enumerate(zip(ids[m][o], s[m][o]), 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def brute_components(rows, width=4, least=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("crowded,block,settled", [(160, 1024, 2048), (4, 1024, 2048), (4, 1024, 3), (4, 6, 3)])
def test_jaccard_components(spark, monkeypatch, crowded, block, settled):
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "OFTEN", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ALL", settled)
    monkeypatch.setattr(jaccard_join, "PIVOTS", (2, 8))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(n)] for n in (60, 60, 200)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "É x y z"), (8, "é x y z")]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + i, " ".join(w)))
    passage = " ".join(base[0][:30])
    rows += [(300 + i, " ".join(word() for _ in range(60)) + " " + passage) for i in range(20)]
    df = spark.createDataFrame([*rows, (None, "one two three")], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got.pop(None) == (1, 6)
    assert got == brute_components(rows)


def test_parities_bound_what_two_sets_have_apart():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64)
        x, y = (np.unique(pool[rng.random(len(pool)) < p]) for p in rng.random(2))
        apart = len(np.setxor1d(x, y))
        found = jaccard_join.apart(jaccard_join.parities(x), jaccard_join.parities(y))
        assert found == jaccard_join.apart(jaccard_join.parities(y), jaccard_join.parities(x)) <= apart
    for n in (50, 300, 5000):  # unrelated sets of one size are told apart
        x, y = (jaccard_join.parities(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        assert jaccard_join.apart(x, y) > n / 2 and jaccard_join.apart(x, x) == 0


def test_windows_lose_nothing():
    for n in range(1, 400):
        k = int(jaccard_join.window(np.array([n]))[0])
        for m in range(int(np.ceil(0.85 * n)), int(n / 0.85) + 1):
            least = int(jaccard_join.overlap(np.array([n]), np.array([m]))[0])
            assert n - least < k
            if m >= n:
                assert n - least < int(jaccard_join.window_of_smaller(np.array([n]))[0])


def test_labelled_pages_and_odd_html(spark):
    model = html_extract.train()
    for page in html_pages.LABELLED:
        got = html_extract.extract_page(page, model)
        assert "The committee met" in got or "Rain fell" in got
        assert "We use cookies" not in got and "All rights reserved" not in got and "I was there" not in got and "Subscribe to" not in got
    page = "<article><h1>A &amp; B</h1><p>One  two<br>three &eacute;&#233;<p><b>Four five, six seven.<!-- x --><script>var a = '</p>';</script></article><footer>No text here.</footer>"
    rows = [(1, "u", page, "old"), (2, "u", None, None), (3, "u", "", None), (4, None, "<<<>&lt; </div></p>", None), (None, "u", "<div>" * 3000 + "x", None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == "A & B\nOne two three éé\nFour five, six seven."
    assert {r.page_id: r.text for r in got}[2] == ""


def test_containment(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 8, 20, 60, 300])))) for i in range(30)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.choice([0, 10, 300]))]
        own = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 4])):
            own[rng.randrange(len(own))] = word()
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + ["###"] + [x.upper() for x in own] + w[at:])))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (None, items[4][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*items, (None, items[2][1]), (77, None)], "item_id long, text string")

    def shingles(t, sizes):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + n]) for n in sizes or [min(5, len(w))] for k in range(len(w) - n + 1) if n}

    own = {i: shingles(t, ()) for i, t in items}  # an item of fewer than five words is one shingle
    held = [(i, shingles(t, (1, 2, 3, 4, 5))) for i, t in docs if i is not None]
    want = {(i, k, len(s & h)) for i, h in held for k, s in own.items() if s and len(s & h) >= 0.8 * len(s) - 1e-9}
    assert any(len(next(iter(own[k]))) < 5 for _, k, _ in want)
    assert {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.find(d, b).collect()} == want and want
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not any(s and len(s & h) >= 0.8 * len(s) - 1e-9 for s in own.values()) for h in (shingles(t, (1, 2, 3, 4, 5)) for _, t in docs))  # null ids too


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(x)) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in p.finditer(t or "") if ok(m[0]))


def test_personal_data(spark):
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "x@y.z", "1", "12", "255", "256", ".", "-", " ", "+1", "(2)", "4539 1488 0343 6467", "é", "😀", pii.OPEN, "+49 30 123456", "_", "4111111111111111", "call me at (212) 555-0199"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 20_000), (1003, "1" * 20_000), (1004, "a@b" + ".c" * 5000), (1005, "a@b.c " * 500), (None, "x@y.com")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, spans string").repartition(4)
    found = pii.find(df)
    got = found.select("doc_id", "text", pii.joined(F.col("base_spans")).alias("b"), pii.joined(F.col("spans")).alias("s"), pii.count_of("email").alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.b == base_spans(r.text) and set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert not any(EMAIL.search(r.text) for r in clean.filter("text like '%[EMAIL]%'").collect() if r.text.startswith("x@"))


@pytest.mark.parametrize("run", [
    license_scan.scan, jaccard_join.join, pii.find,
    lambda d: decontaminate.find(d, d.withColumnRenamed("doc_id", "item_id")),
    lambda d: html_extract.extract(d, html_extract.train(), "text"),
    lambda d: vector_search.top_k(d.selectExpr("doc_id as vec_id", "array(1.0D) as embedding"), d.selectExpr("doc_id as vec_id", "array(1.0D) as embedding")),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_links_between_members_of_different_pivots(spark, monkeypatch):
    """Texts that each differ by a few words from an earlier one: chains of links through divided regions."""
    for name, value in (("CROWDED", 8), ("ALL", 8), ("PIVOTS", (6, 96))):
        monkeypatch.setattr(jaccard_join, name, value)
    rng, texts = random.Random(1), [[f"w{k}" for k in range(100)]]
    while len(texts) < 60:
        text = list(rng.choice(texts))
        for at in rng.sample(range(100), rng.choice((2, 2, 3))):
            text[at] = f"x{rng.random()}"
        texts.append(text)
    sets = [{tuple(t[k : k + 4]) for k in range(97)} for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == dict(enumerate(root))


def test_settled_regions_of_the_same_texts_are_measured_together(spark):
    """Regions with the same members have one plan with all their pivots, others one of their own; each is divided once."""
    rows = [(region, rep, 100, 0, 0, 5, rep % 50 == region) for region in range(8) for rep in range(400)]
    rows += [(8, rep, 100, 0, 0, 5, rep < 1010) for rep in range(1000, 1300)]  # other members
    rows += [(9, rep, 100, 0, 0, 5, True) for rep in range(400)]  # to be divided
    live = spark.createDataFrame(rows, "region long, rep long, n long, pos long, prev long, rare long, home boolean")
    sizes = spark.createDataFrame([(k, 8 if k < 8 else 10, 1) for k in range(9)] + [(9, 400, 2)], "region long, homes long, how int")
    named, chosen = jaccard_join.plan(live, sizes, 64)
    plans = {r.region: r["plan"] for r in named.collect()}
    assert named.count() == 10 and plans == {**dict.fromkeys(range(8), 0), 8: 8, 9: 9}
    got = {p: [(r.k, r.rep, r.settled) for r in chosen.filter(f"plan = {p}").orderBy("k").collect()] for p in (0, 8, 9)}
    assert [r for _, r, _ in got[0]] == [r for r in range(400) if r % 50 < 8] and [r for _, r, _ in got[8]] == list(range(1000, 1010)) and [r for _, r, _ in got[9]] == list(range(64))
    assert all([k for k, *_ in x] == list(range(len(x))) for x in got.values()) and {p: x[0][2] for p, x in got.items()} == {0: True, 8: True, 9: False}
