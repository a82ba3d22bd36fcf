"""Cases that an operator once left out."""

from tidemark.llm import decontaminate, license_scan, license_texts, pii


def names(text):
    return [(h[0], h[1]) for h in license_scan.scan_text(text)]


def test_licenses_behind_other_cues():
    far = "Copyright 2020 the authors of this work and of all its parts and files in every form and place."
    assert names(far + " Licensed under the Apache License, Version 2.0.") == [("Apache-2.0", "notice")]
    for gap in range(30):
        assert names("Copyright 2020 " + "word " * gap + "licensed under the Apache License, Version 2.0.") == [("Apache-2.0", "notice")]
    kinds = list(license_texts.TEXTS)
    for k in range(len(kinds)):
        row = [kinds[(k + j) % len(kinds)] for j in (0, 3, 4)]
        for n in (2, 3):
            assert names(" Of another part. ".join(license_texts.TEXTS[x] for x in row[:n])) == [(x, "text") for x in row[:n]]


def test_a_text_cut_by_a_block_is_not_taken_for_a_shorter_one():
    for gap in range(150, 290, 7):
        assert names("Copyright 2020 " + "word " * gap + license_texts.TEXTS["BSD-3-Clause"]) == [("BSD-3-Clause", "text")]


def test_licenses_behind_those_that_save_more_bytes():
    assert ("ISC", "notice") in names("licensed under the GNU General Public License v2 or the ISC License")
    assert ("CC0-1.0", "notice") in names("Licensed under the GNU General Public License v3, documentation under CC0 1.0.")


def test_notices_in_other_spellings():
    for text, want in [
        ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("Licensed under Apache-2.0.", ["Apache-2.0"]),
        ("available under CC-BY-4.0", ["CC-BY-4.0"]), ("under CC0-1.0", ["CC0-1.0"]), ("Released under the MIT licence.", ["MIT"]), ("License: MIT", ["MIT"]),
        ("licensed under the GNU General Public License v3", ["GPL-3.0"]), ("released under GPLv2", ["GPL-2.0"]), ("under the Apache License 2.0", ["Apache-2.0"]),
        ("under the GNU Generel Public License, version 3", ["GPL-3.0"]), ("licensed under the GNU General Public License v2 or the ISC License", ["GPL-2.0", "ISC"]),
    ]:
        assert [n for n, _ in names(text)] == want, text
    # Other versions, other licences and other words stay apart.
    for text in ["Licensed under the Apache License, Version 1.1", "under the GNU Library General Public License, version 2", "under the Mozilla Public License 1.1", "published by MIT", "Released in Ulm mit Apache", "GPL"]:
        assert names(text) == [], text
    for name, spellings in license_texts.SPELLINGS.items():
        for s in spellings:
            assert [n for n, _ in names(f"This is licensed under the {s}. And more.")] == [name], s


def test_overlapping_spans_are_replaced_whole(spark):
    cases = {
        "a 192.168.1.10@host.example b": "a [EMAIL] b", "+15551234567@example.com": "[EMAIL]",  # one start, the longer one later
        "call +1 555 123 4567@example.com now": "call [EMAIL] now", "call +1 555 123 4567@a.io now": "call [PHONE] now",  # the tail of either
        "x@y.com, 10.0.0.1 and z@y.com.": "[EMAIL], [IP] and [EMAIL].", "none": "none", "": "",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}


def test_documents_without_an_id_of_their_own_are_cleaned(spark):
    item = "one two three four five six seven eight"
    rows = [(None, "so " + item), (None, "nothing here"), (1, item), (1, "another text with the same id"), (2, "free of it"), (3, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _row int")
    kept = decontaminate.clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["_row"] for r in kept.collect()) == [1, 3, 4, 5]


def test_many_spans_in_one_document(spark):
    """Thousands of spans in one text, added ones among base ones, and none that overlaps a base span."""
    text = "".join(f"call me at (212) 555-{i:04d} or mail a{i}@b.org, " for i in range(1500))
    docs = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "", 7)], "key long, text string, _key int")
    got = {r.key: r for r in pii.find(docs).collect()}
    base = [(s.start, s.end) for s in got[1].base_spans]
    added = [(s.start, s.end) for s in got[1].spans if s.kind not in pii.BASE]
    assert len(base) == 1500 and added and not any(b[0] < a[1] and a[0] < b[1] for a, b in zip(added, base)) and got[2].spans == got[3].spans == []
    clean = {r.key: (r.text, r["_key"]) for r in pii.redact(docs).collect()}
    assert clean[1][0].count("[EMAIL]") == 1500 and clean[1][0].count("[TEL]") == len(added) and "@" not in clean[1][0] and clean[2] == (None, 6) and clean[3] == ("", 7)


def test_reliabilities_part_good_labelers_from_bad_ones():
    """Expectation-maximisation on counts drawn from known reliabilities."""
    truth = {("tel", *votes): 0.0 for votes in [(a, b, c, d) for a in (-1, 1) for b in (-1, 1) for c in (-1, 0, 1) for d in (-1, 1)]}
    for real, share in ((1, 0.4), (-1, 0.6)):
        for k in truth:
            good = [0.9 if v == real else 0.1 for v in (k[1], k[2], k[4])]
            truth[k] += 1000 * share * good[0] * good[1] * good[2] * (0.6 if k[3] == 0 else 0.3 if k[3] == real else 0.1)
    table, post = pii.reliabilities(truth)
    assert post["tel", 1, 1, 1, 1] > 0.95 and post["tel", -1, -1, -1, -1] < 0.05
    assert all(abs(table[j][1, 1] - 0.9) < 0.1 and abs(table[j][1, 0] - 0.1) < 0.1 for j in (0, 1, 3))
