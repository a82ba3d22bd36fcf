"""Main text of web pages by a tree-structured graphical model (operator 8).

Each block element of a page is a variable: main text or not. Its potential comes from what the element looks like,
and a potential between parent and child from how often labelled pages change over there. Messages go from the leaves
to the root and back (sum-product), which gives every element's exact marginal; text of elements that are more likely
main text than not is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, small_batches, text_slices, with_fields
from tidemark.llm.html_pages import LABELLED
from tidemark.llm.html_tree import Tree

#: At most about so many pages of the table are learnt from: pages whose markup names the article.
TRAIN_PAGES = 300
SMOOTH = 0.5
#: The labelled pages of the package count as much as if each were there so many times.
WEIGHT = 10
#: Tags with a potential of their own; others share one.
TAGS = set("article aside blockquote body dd div dl dt fieldset figcaption figure footer h1 h2 h3 h4 header html li main nav ol p pre section table tbody td th tr ul".split())
#: Tags that a page may well use for other things, or not at all: pages are also learnt from without them.
NAMED = "article main nav header footer aside section"


def looks(tree: Tree, i: int) -> tuple[str, ...]:
    """What an element looks like, as a few values of few kinds."""
    n, linked = tree.chars[i], tree.linked[i]
    size = min(6, n.bit_length() // 2)  # by powers of four
    density = "none" if not n else "0" if not linked else "low" if linked < 0.3 * n else "mid" if linked < 0.6 * n else "high"
    stops = "none" if not n else "few" if tree.stops[i] * 60 < n else "some"
    tag = tree.tags[i]
    return (f"tag={tag if tag in TAGS else 'other'}", f"cue={tree.cues[i]}", f"size={size}", f"links={density}", f"stops={stops}")


def labels_of(tree: Tree) -> list[int] | None:
    """1 for elements in the main text: by data-label attributes, or else by article and main tags; None without."""
    marked = any(x is not None for x in tree.labels)
    inside = [0] * len(tree.tags)
    for i in range(1, len(tree.tags)):
        up = inside[tree.parents[i]]
        if marked:
            inside[i] = up if tree.labels[i] is None else tree.labels[i]
        elif tree.tags[i] in ("article", "main"):
            inside[i] = 1
        else:
            inside[i] = int(up and tree.cues[i] != "against" and tree.tags[i] not in ("nav", "aside", "footer"))
    return inside if any(inside) else None


_NAMES = re.compile(rf"<(/?)(?:{NAMED.replace(' ', '|')})\b", re.I)


def count_page(page: str, sums: Counter, weight: float = 1) -> None:
    """Add what a labelled page teaches, as it is and with the names of its sections taken away."""
    tree = Tree(page)
    found = labels_of(tree)
    if found is None:
        return
    for own in (tree, Tree(_NAMES.sub(r"<\1div", page))):
        if len(own.tags) != len(found):
            continue
        for i in range(1, len(found)):
            if not own.hidden[i]:
                sums["turn", found[own.parents[i]], found[i], "framed" if own.framed[own.parents[i]] else ""] += weight
                for value in looks(own, i):
                    sums["look", found[i], 0, value] += weight


def train(pages: DataFrame | None = None, html_col: str = "html", most: int = TRAIN_PAGES) -> dict:
    """Potentials from the labelled pages of the package and, of the given table, about `most` pages that name their
    article (drawn by a hash of their text). Only counts of looks and turns reach the driver."""
    sums: Counter = Counter()
    for page in LABELLED:
        count_page(page, sums, WEIGHT)
    if pages is not None:
        small_batches(pages.sparkSession)
        named = pages.select(F.col(html_col).alias("html")).filter(F.lower("html").rlike("<(article|main)\\b"))
        n = named.count()
        picked = named.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < 1_000_000 * min(1.0, most / max(n, 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Counter = Counter()
            for _, texts in text_slices(batches, 0):
                for t in texts:
                    count_page(t, own)
            if own:
                kind, a, b, value = zip(*own)
                yield pa.RecordBatch.from_pydict({"kind": kind, "a": a, "b": b, "value": value, "n": pa.array(own.values(), pa.float64())})

        for r in arrow_map(picked, run, "kind string, a long, b long, value string, n double").groupBy("kind", "a", "b", "value").agg(F.sum("n").alias("n")).collect():
            sums[r["kind"], r["a"], r["b"], r["value"]] += r["n"]
    turn = {}
    for framed in ("", "framed"):
        rows = [[sums["turn", a, b, framed] + SMOOTH for b in (0, 1)] for a in (0, 1)]
        turn[framed] = [[math.log(x / sum(row)) for x in row] for row in rows]
    values = {k[3] for k in sums if k[0] == "look"}
    kinds = Counter(v.split("=")[0] for v in values)
    total = [Counter(), Counter()]
    for (kind, a, _, value), n in sums.items():
        if kind == "look":
            total[a][value.split("=")[0]] += n
    look = {v: [math.log(sums["look", a, 0, v] + SMOOTH) - math.log(total[a][v.split("=")[0]] + SMOOTH * (1 + kinds[v.split("=")[0]])) for a in (0, 1)] for v in values}
    return {"turn": turn, "look": look}


def marginals(tree: Tree, model: dict) -> list[float]:
    """The probability of each element to be main text: sum-product up and down the tree."""
    look, n = model["look"], len(tree.tags)
    plain, framed = model["turn"][""], model["turn"]["framed"]
    turns = [framed if tree.framed[p] else plain for p in tree.parents]  # from the parent's value to the element's
    own = [[0.0, 0.0] for _ in range(n)]
    own[0][1] = -1e9  # the page itself is no main text
    for i in range(1, n):
        if tree.hidden[i]:
            own[i][1] = -1e9
            continue
        for value in looks(tree, i):
            if value in look:
                own[i][0] += look[value][0]
                own[i][1] += look[value][1]

    def plus(a: float, b: float) -> float:
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    up = [x[:] for x in own]  # what stands below an element, with itself
    sent: list[list[float]] = [[0.0, 0.0]] * n  # the message of an element to its parent
    for i in range(n - 1, 0, -1):
        turn = turns[i]
        sent[i] = [plus(turn[a][0] + up[i][0], turn[a][1] + up[i][1]) for a in (0, 1)]
        p = up[tree.parents[i]]
        p[0] += sent[i][0]
        p[1] += sent[i][1]
    out, down = [0.0] * n, [[0.0, 0.0]] * n
    for i in range(n):
        if i:
            p = tree.parents[i]
            rest = [down[p][a] + up[p][a] - sent[i][a] for a in (0, 1)]  # all of the page but what is below i
            most, turn = max(rest), turns[i]
            down[i] = [plus(rest[0] - most + turn[0][b], rest[1] - most + turn[1][b]) for b in (0, 1)]
        x = [down[i][b] + up[i][b] for b in (0, 1)]
        out[i] = 1 / (1 + math.exp(min(700.0, x[0] - x[1])))
    return out


def extract_page(page: str, model: dict) -> str:
    tree = Tree(page)
    return tree.text([p > 0.5 for p in marginals(tree, model)])


def extract(pages: DataFrame, model: dict, html_col: str = "html") -> DataFrame:
    """The frame's columns (without the html) plus text and n_chars (code points).

    A null or empty page gives an empty text, and so does one without main text. Rows stay one to one; repeated pages
    give the same text; columns named text or n_chars are replaced. Nothing is cut, however long a page is.
    """
    small_batches(pages.sparkSession)
    kept = pages.drop(*({"text", "n_chars"} - {html_col}))
    place = kept.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, place):
            found = [extract_page(t, model) if t else "" for t in texts]
            columns = [c for k, c in enumerate(batch.columns) if k != place]
            names = [c for k, c in enumerate(batch.schema.names) if k != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*names, "text", "n_chars"])

    return arrow_map(kept, run, with_fields(kept.drop(html_col), text="string", n_chars="bigint"))
