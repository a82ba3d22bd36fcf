"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import prefix_trie, queries_repeats, spelling_variants, substring_dedup
from tidemark.llm.common import table

NONE = hashlib.sha256(b"").hexdigest()
TURNS = "conv_id long, turn long, role string, text string"


# --- 11


def nodes(convs: dict) -> dict:
    """(smallest member, depth) -> (parent's, members, children, leaves, saved, hash of the ids that end there)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items()}


def got(df) -> dict:
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def in_order(rows: list) -> dict:
    convs = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[conv].append((role or "", text or ""))
    return dict(convs)


def test_trie_of_random_conversations(spark, monkeypatch):
    """Random ones, copies, chains on chains (each is the one before with a turn more, or branches off its end), and a node at
    which many end, whose ids are hashed in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rng, rows = random.Random(11), []
    for c in range(60):
        length = rng.choice([1, 2, 3, 8, 9, 16, 17, 40])
        for t in range(length):
            rows.append((c, t, rng.choice(["user", None]) if t % 7 == 6 else "user", "é" * rng.choice([1, 1, 1, 1, 2]) + (str(t) if t < 20 else "")))
    for c in range(60, 75):  # a group of copies, and one that goes on
        rows += [(c, t, "user", f"same {t}") for t in range(10 if c < 74 else 30)]
    rows += [(None, 0, "user", "nobody"), (200, 0, None, None), (201, None, "a", ""), (201, 4, "b", "x"), (-3, 1, "user", "é")]
    rows += [(300 + c, t, "v", f"{t}") for c in range(12) for t in range(c + 1)] + [(400 + c, t, "v", f"{t}" if t < c else f"{c} {t}") for c in range(12) for t in range(c + 3)]
    rows += [(1000 + c, 0, "u", "many") for c in range(300)]
    rng.shuffle(rows)
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5))) == nodes(in_order(rows))


def test_trie_of_tied_and_repeated_turns_has_one_result(spark):
    rows = [(c, 0, "u", t) for c in (1, 2, 3) for t in ("b", "a", "a")]
    made = [got(prefix_trie.prefix_trie(spark.createDataFrame(r, TURNS).repartition(n))) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert made[0] == made[1] and {k[0] for k in made[0]} == {1} and max(k[1] for k in made[0]) == 3


def test_trie_of_nothing_and_of_clashing_columns(spark):
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))) == {}
    wide = spark.createDataFrame([(1, 0, "u", "a", 5, "x", 7)], TURNS + ", place long, h1 string, depth long")
    assert set(got(prefix_trie.prefix_trie(wide))) == {(1, 0), (1, 1)}


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", rng.choice("ab")) for c in [*range(0, 40), 43, 44, 47, -1, -2, -5] for t in range(rng.choice([1, 2, 9, 12]))]
    rows += [(c, 0, "user", "a") for c in (61, 62, 63, 64, 66, 67, 68, 69)]  # without their first one
    convs, want = in_order(rows), {}
    for c, turns in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        want[c] = convs.get(base, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    made = prefix_trie.trie(queries_repeats.rebuilt(prefix_trie.places(spark.createDataFrame(rows, TURNS))))
    assert got(made) == nodes(want)


# --- 12


def kept_words(docs: list, window: int) -> dict:
    """(doc_id, text) -> (words, removed, kept)."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in docs}, key=lambda d: d[:2])
    first: dict = {}
    gone: dict = {}
    for d in order:
        words = d[2].encode().split()
        gone[d] = set()
        for s in range(len(words) - window + 1):
            if first.setdefault(tuple(words[s : s + window]), (d, s)) != (d, s):
                gone[d] |= set(range(s, s + window))
    return {d: (len(d[2].encode().split()), len(g), b" ".join(w for k, w in enumerate(d[2].encode().split()) if k not in g).decode()) for d, g in gone.items()}


def check_kept(spark, docs: list, window: int, wide: str = "", more: tuple = ()) -> None:
    want = kept_words(docs, window)
    frame = spark.createDataFrame([(*d, *more) for d in docs], "doc_id long, text string" + wide).repartition(4)
    rows = substring_dedup.deduplicate(frame, window).collect()
    expected = sorted((i is not None, i or 0, *want[(i is not None, i or 0, t or "")]) for i, t in docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in rows) == expected


def test_removed_windows(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 4, 5, 60])))) for k in range(80)]
    docs += [(100 + k, f"start{k} {passage} é ü end{k}\n\t x\x0b y\x0c z\r" + passage) for k in range(20)]
    docs += [(None, "a b a b a b a b"), (7000, None), (7001, ""), (7002, " \n\t "), (7003, "w " * 5000)]
    check_kept(spark, docs, 5)


def test_windows_of_long_texts_and_repeated_rows(spark):
    long = " ".join(str(k % 4999) for k in range(30000))
    docs = [(1, long), (2, long), (2, long), (3, long[1000:]), (4, "only this")]
    check_kept(spark, docs, 20, ", id long, tie long, starts string, kept string", (1, 2, "s", "k"))


def test_words_split_at_the_six_characters_only(spark):
    text = "a\x1cb\x1dc\x85d e f"
    rows = substring_dedup.deduplicate(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2).collect()
    assert [(r.n_words, r.kept) for r in rows] == [(2, text)]


def test_equal_ids_take_their_texts_apart(spark):
    docs = [(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (5, "x y z"), (5, "q a b c d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(frame, 3).collect())
    assert rows == Counter({(None, 4, 0, "a b c d"): 2, (None, 3, 0, "x y z"): 1, (5, 3, 3, ""): 1, (5, 5, 4, "q"): 1})


def test_no_documents_to_cut(spark):
    assert substring_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_maximal_intervals(spark):
    rows = substring_dedup.intervals(spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d x a b c y z e f g")], "doc_id long, text string"), 3).collect()
    assert [(r.id, list(zip(r.starts, r.ends))) for r in rows] == [(2, [(0, 4), (5, 8), (10, 13)])]


# --- 13


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def groups(n: dict) -> dict:
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def made(df) -> dict:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(rng: random.Random, many: int) -> dict:
    out = {}
    while len(out) < many:
        w = "".join(rng.choice("aéb") for _ in range(rng.choice([5, 6, 7, 8])))
        out[w] = rng.choice([3, 3, 4, 6, 7, 12, 24, 100])
    return out | {"aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "x" * 300: 3, "x" * 301: 9}


@pytest.mark.parametrize("slab, heavy", [(1 << 11, 1 << 16), (16, 20)])
def test_variants_of_a_vocabulary(spark, monkeypatch, slab, heavy):
    monkeypatch.setattr(spelling_variants, "SLAB", slab)
    monkeypatch.setattr(spelling_variants, "HEAVY", heavy)
    n = vocabulary(random.Random(13), 400)
    docs = [(k, " ".join([w] * c)) for k, (w, c) in enumerate(n.items())]
    assert made(spelling_variants.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == groups(n)


def test_words_are_counted_as_the_query_wants(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(["Straße", "straße", "ÉCLAIRS", "éclairs", "CLAIRS7clairs", "foo_barbaz", "naïveté"]) for _ in range(40))) for k in range(60)]
    docs += [(None, "clairs clairs clairs"), (500, None), (501, ""), (502, "tiny it 123")]
    n: Counter = Counter()
    for i, t in docs:
        for run in spelling_variants.RUN.findall(t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode()) if i is not None else 1
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n long")
    assert made(spelling_variants.variants(frame, change=queries_repeats.letter_lost)) == groups(n)


def test_no_words(spark):
    for docs in ([], [(1, None), (2, "a b c")]):
        assert spelling_variants.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect() == []


def test_each_near_pair_is_found_on_real_words(spark):
    found = {r.word: r.n for r in spelling_variants.words(table(spark, "/root/testdata/sf0.001", "documents")).collect()}
    some = dict(sorted(found.items())[:700])
    frame = spark.createDataFrame(list(some.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form) for r in spelling_variants.near_words(frame).collect()}
    for w in some:
        near = [v for v in some if one_apart(w, v)]
        assert got[w] == (len(near), min(near, key=lambda x: (-some[x], x)) if near else None)
