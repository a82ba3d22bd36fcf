"""Licence scan by conditional compression (operator 1).

Around words that licences use, a document gives candidate blocks. A block is compressed by zstandard alone and with
each licence's wording as a raw dictionary; wordings are ranked by how many bytes they save. All that save enough are
confirmed, or not, by the exact differences in wording between them and the part of the block that they match.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, small_batches, text_slices
from tidemark.llm.license_texts import SPELLINGS, TEXTS

#: Words that begin a candidate block, as a pattern for Spark and Python alike.
CUES = r"(?i)\b(licen[cs]|copyright|permission is|permission to|redistribution|spdx|free software|source code form|cc[\s-]+by|cc0|creative commons|[al]?gpl|mpl|epl|bsl|bsd|apache|artistic|provided .as.is)"
#: Words before and after the first cue of a block: more than the longest wording has.
BEFORE, AFTER = 40, 280
#: The same for notices, which are short.
NEAR = (12, 24)
#: Words that the longest wording may take in a document.
LONGEST = 160
#: A text is looked at if it saves at least this many bytes. Notices always are: the shortest save less.
SAVES = 4
#: A text is confirmed if at most this share of its words differs.
DIFFERS = 0.1
#: A notice has one of these words at most so many words before the licence's name.
LEADS, LEAD_WITHIN = set("licensed license licence released distributed available covered published under identifier spdx-license-identifier".split()), 8
#: The lead of an identifier, and the words that may stand between identifiers and between names that share a lead.
TAG, JOINS = "spdx-license-identifier", set("or and with either the a an".split())
#: A notice's name may differ from a spelling of at least LONG_NAME words by NAME_DIFFERS words, if these are of the
#: words that don't tell licences apart: left out, put in, or written LIKE them by this share of the letters.
LONG_NAME, NAME_DIFFERS, LIKE = 4, 1, 0.7
PLAIN = set("license version general public software the a of terms v ver release as international".split())

#: zstandard does not look up the first and last bytes of a dictionary, so the wording stands between others.
PAD = bytes(range(128, 192))
#: What stands in place of the words of a notice found, without and with the SPDX tag.
NOTICE, TAGGED = "\x00", "\x01"
FOUND = ("", NOTICE, TAGGED)

_WORDS = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def plain(word: str) -> str:
    """A word as notices are compared by: one spelling of licence, and versions without their v."""
    word = word.replace("licence", "license")
    return word[1:] if re.fullmatch(r"v[0-9.]+", word) else word


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m[0].lower(), m.span()) for m in _WORDS.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


class Wordings:
    """All wordings with their dictionaries."""

    def __init__(self):
        import zstandard as z

        # The fast strategy with a target length leaves literals as they are: bytes saved are then bytes matched.
        how = z.ZstdCompressionParameters.from_level(1, strategy=z.STRATEGY_FAST, target_length=1, min_match=4, hash_log=14, write_content_size=False, write_dict_id=False)
        self.plain = z.ZstdCompressor(compression_params=how)
        self.all = []
        for kind, table in (("notice", SPELLINGS), ("text", {name: [raw] for name, raw in TEXTS.items()})):
            for name, raws in table.items():
                words = words_of(raws[0] if kind == "text" else f"licensed under the {raws[0]}")[0]
                # A notice's dictionary holds its other spellings too; the first one stands last, where matches cost least.
                data = " ".join(" ".join(words_of(raw)[0]) for raw in raws[:0:-1])
                d = z.ZstdCompressionDict(PAD + f"{data} {' '.join(words)}".strip().encode() + PAD, dict_type=z.DICT_TYPE_RAWCONTENT)
                own = z.ZstdCompressor(compression_params=how, dict_data=d)
                spelled = {(n := tuple(map(plain, words_of(raw)[0]))): frozenset(n) - PLAIN for raw in raws}
                self.all.append((name, kind, words, words_of(raws[0])[0], own, spelled))

    def ranked(self, block: list[str], kind: str) -> list[tuple[int, tuple]]:
        """The wordings of a kind that may be in the block, those that save most bytes of it first."""
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        saved = [(alone - len(w[4].compress(data)), w) for w in self.all if w[1] == kind]
        return sorted((s for s in saved if kind == "notice" or s[0] >= SAVES), key=lambda s: (-s[0], s[1][0]))


@lru_cache(maxsize=1)
def wordings() -> Wordings:
    return Wordings()


def confirm(block: list[str], wording: tuple) -> tuple[int, int, int] | None:
    """(first word, word after the last, words that differ) of the wording in the block; None if it isn't there."""
    _, kind, words, _, _, spelled = wording
    if kind == "notice":
        return _notice(block, spelled)
    m = SequenceMatcher(None, words, block, autojunk=False)
    a, b, n = m.find_longest_match(0, len(words), 0, len(block))
    if n < 4:
        return None
    room = max(3, len(words) // 8)
    low, high = max(0, b - a - room), min(len(block), b - a + len(words) + room)
    blocks = SequenceMatcher(None, words, block[low:high], autojunk=False).get_matching_blocks()[:-1]
    if not blocks:
        return None
    first, last = low + blocks[0].b, low + blocks[-1].b + blocks[-1].size
    differ = _differences(words, block[first:last])
    return (first, last, differ) if differ <= DIFFERS * len(words) else None


def _notice(block: list[str], spelled: dict[tuple, frozenset]) -> tuple[int, int, int] | None:
    """confirm() for a notice: the place of fewest differing words in lead and name, the longest name of those."""
    present, hits = set(block), []
    for name, telling in spelled.items():
        if not telling <= present:
            continue
        n = len(name)
        for at in [k for k, w in enumerate(block) if w == name[0]]:
            if tuple(block[at : at + n]) == name:
                size, differ = n, 0
            elif n >= LONG_NAME and telling <= set(block[at : at + n + NAME_DIFFERS]):
                size, differ = _near_name(block[at : at + n + NAME_DIFFERS], name)
                if not size:
                    continue
            else:
                continue
            lead = _lead(block, at, n == 1 and not any(c.isdigit() for c in name[0]))
            if lead:
                hits.append((differ + lead[1], -size, at, lead[0]))
    if not hits:
        return None
    differ, size, at, begin = min(hits)
    return begin, at - size, differ


def _near_name(have: list[str], name: tuple) -> tuple[int, int]:
    """(words, differences) of the start of `have` that is the name but for words that don't tell licences apart; (0, 0) if none is."""
    for size in (len(name), len(name) - 1, len(name) + 1):
        part, differ = have[:size], 0
        if len(part) < size or part[-1] != name[-1] or not set(part).isdisjoint(FOUND):
            continue
        for op, a, b, c, d in SequenceMatcher(None, name, part, autojunk=False).get_opcodes():
            if op == "equal":
                continue
            out, new = name[a:b], part[c:d]
            like = len(out) == len(new) == 1 and not any(x.isdigit() for x in new[0]) and SequenceMatcher(None, out[0], new[0]).ratio() >= LIKE
            differ += max(b - a, d - c) if set(out) <= PLAIN and (like or set(new) <= PLAIN) else len(name)
        if differ <= NAME_DIFFERS:
            return size, differ
    return 0, 0


def _lead(block: list[str], at: int, tagged: bool) -> tuple[int, int] | None:
    """(first word, words that differ) of the lead of a name at a place; None if there is none.

    A name behind another notice and joining words shares that one's lead, as in a choice of two. tagged: the lead must
    stand right before the name, as the SPDX tag (or others of its expression), `license` or `licensed under`.
    """
    joined = at
    while joined and block[joined - 1] in JOINS:
        joined -= 1
    if tagged:
        if block[max(0, joined - 2) : joined] == ["licensed", "under"]:
            return joined - 2, 0
        if at and block[at - 1] == "license":
            return at - 1, 2
        return (joined - 1, 0) if joined and block[joined - 1] == TAG else (at, 0) if 0 < joined < at and block[joined - 1] == TAGGED else None
    if joined and block[joined - 1] == TAG:
        return joined - 1, 0
    leads = [k for k in range(max(0, at - LEAD_WITHIN), at) if block[k] in LEADS]
    if leads:
        have, want = block[leads[0] : at], ["licensed", "under", "the"]
        return leads[0], min(_differences(want, have), _differences(want[:-1], have))  # with and without an article
    return (at, 0) if 0 < joined < at and block[joined - 1] in (NOTICE, TAGGED) else None


def _differences(want: list[str], have: list[str]) -> int:
    """Words left out, put in or changed."""
    return sum(max(b - a, d - c) for op, a, b, c, d in SequenceMatcher(None, want, have, autojunk=False).get_opcodes() if op != "equal")


def best(block: list[str], kind: str) -> tuple[tuple, tuple[int, int, int], int] | None:
    """(wording, its place and differences, bytes saved) of the wording of a kind that fits the block best; None if none is there."""
    hit = None
    for saved, wording in wordings().ranked(block, kind):
        got = confirm(block, wording)
        # Fewer differing words, then longer names or texts, then more bytes saved.
        if got and (hit is None or (got[2], -len(wording[3]), -saved) < hit[0]):
            hit = ((got[2], -len(wording[3]), -saved), (wording, got, saved))
    return hit and hit[1]


def scan_text(text: str) -> list[tuple[str, str, int, int, int, int]]:
    """(licence, kind, start, end, bytes saved, words that differ) of each licence found, in order of place.

    Texts are looked for first, in blocks longer than they are; then notices near each cue, outside the texts found.
    Blocks overlap, so that a wording is whole in the block of its own cue whatever stands before it. A notice may use
    any of the licence's spellings in license_texts, but for NAME_DIFFERS words that don't tell licences apart; other
    names, and names without a version that licences are told apart by, are not looked for.
    """
    words, spans = words_of(text)
    starts, found = [s for s, _ in spans], []
    cues = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in re.finditer(CUES, text)})
    for kind, before, after in (("text", BEFORE, AFTER), ("notice", *NEAR)):
        words = list(map(plain, words)) if kind == "notice" else words
        for at in cues:
            while words[at] not in FOUND:  # each cue has its own whole window, until it lies in a wording found
                low, upto = max(0, at - before), min(len(words), at + after)
                hit = best(words[low:upto], kind)
                # What begins too near the end of the window may be cut there: it is looked at again with its own window.
                while hit and upto < len(words) and low + hit[1][0] + LONGEST > upto and low + hit[1][0] > at:
                    begins = low + hit[1][0]
                    own = max(0, begins - before), min(len(words), begins + after)
                    again = best(words[own[0] : own[1]], kind)
                    if again is None:
                        break
                    (low, upto), hit = own, again
                    if low + hit[1][0] <= begins:
                        break
                if hit is None:
                    break
                wording, (a, b, differ), saved = hit
                found.append((wording[0], kind, spans[low + a][0], spans[low + b - 1][1], saved, differ))
                tagged = TAG in words[low + a : low + b] or low + a >= 2 and TAGGED in words[low + a - 2 : low + a]
                words[low + a : low + b] = ["" if kind == "text" else TAGGED if tagged else NOTICE] * (b - a)  # look for others in the rest
    return sorted(found, key=lambda f: f[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, kind, start, end, saved, n_diff, exact): a row for each licence that a document names or holds.

    start and end are code points, end exclusive; saved is in bytes; exact: no word differs. Null and empty texts, and
    documents without a licence, give no row; repeated documents give their rows again; ids may be null. Whole texts
    are looked at: only documents without any cue word are left aside, in Spark.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = [(k, *hit) for k, t in enumerate(texts) for hit in scan_text(t)]
            k, name, sort, start, end, saved, differ = zip(*rows) if rows else [()] * 7
            ids = batch.column(0).take(pa.array(k, pa.int64()))
            numbers = [pa.array(x, pa.int64()) for x in (start, end, saved, differ)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(name, pa.string()), pa.array(sort, pa.string()), *numbers, pa.array([d == 0 for d in differ], pa.bool_())], ["id", "license", "kind", "start", "end", "saved", "n_diff", "exact"])

    cued = docs.select(id_col, text_col).filter(F.col(text_col).rlike(CUES))
    return arrow_map(cued, run, f"id {kind}, license string, kind string, start long, end long, saved long, n_diff long, exact boolean").withColumnRenamed("id", id_col)
