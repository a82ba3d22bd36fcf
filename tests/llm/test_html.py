"""Main text: pages of several layouts, and marginals against sums over all labellings of small trees."""

import itertools
import math
import random

import pytest

from tidemark.llm import html_extract, vector_search
from tidemark.llm.html_tree import Tree

SENTENCES = "The river rose in the night, and the town woke late. Nobody had heard the bells, for the wind stood in the west. By noon the bridge was gone. The miller counted his sacks, wrote a letter, and waited for the water to fall."
MORE = "A week later the road was dry again, and carts came over the hill. They brought flour, nails and news. The letter had arrived, but no answer came with it; so the miller wrote another one."
MENU = '<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul>'


@pytest.fixture(scope="module")
def model():
    return html_extract.train(None)


def article(model, inside: str) -> str:
    return html_extract.extract_page(f"<html><head><title>t</title></head><body>{inside}</body></html>", model)


def test_attributes_of_any_value(model):
    table = '<table><tr><td data-label="Account">1</td><td data-label="">2</td><td data-label=7>3</td></tr></table>'
    assert SENTENCES in article(model, f"<article><h1>Flood</h1><p>{SENTENCES}</p>{table}<p>{MORE}</p></article>")
    assert [x for x in Tree('<div data-label="1"><p data-label="0">a</p><p data-label="x">b</p></div>').labels if x is not None] == [1, 0]


def test_a_form_around_the_page_and_forms_within(model):
    whole = f'<form method="post" action="page.aspx"><input type="hidden" name="state" value="x">{MENU}<h1>Flood</h1><p>{SENTENCES}</p><p>{MORE}</p><p>{SENTENCES}</p></form>'
    text = article(model, whole)
    assert text.count(SENTENCES) == 2 and MORE in text
    small = f'<article><h1>Flood</h1><p>{SENTENCES}</p><form><p>Your name, please.</p><label>Mail</label><input><button>Send it</button></form><p>{MORE}</p></article>'
    text = article(model, small)
    assert SENTENCES in text and MORE in text and "name" not in text and "Mail" not in text and "Send" not in text


@pytest.mark.parametrize("name", ["page", "no-sidebar", "wrap sidebar-right", "content with-sidebar", "has-navbar"])
def test_names_of_a_wrapper(model, name):
    side = '<div class="sidebar"><p><a href="/x">Other news</a></p><p><a href="/y">Weather</a></p></div>'
    text = article(model, f'<div class="{name}"><h1>Flood</h1><p>{SENTENCES}</p><p>{MORE}</p>{side}</div>')
    assert SENTENCES in text and MORE in text and "Weather" not in text


def test_comments_longer_than_the_article_stay_out(model):
    comments = '<div class="comments">' + "".join(f'<div class="comment"><p>{MORE} I say so, {k}.</p></div>' for k in range(6)) + "</div>"
    text = article(model, f'<article><h1>Flood</h1><p>{SENTENCES}</p></article>{comments}')
    assert SENTENCES in text and "I say so" not in text


def joint(tree: Tree, model: dict, values: tuple) -> float:
    """The weight of one labelling of all elements, by its definition."""
    out = 0.0
    for i in range(1, len(values)):
        if tree.hidden[i]:
            out += -1e9 if values[i] else 0.0
        else:
            out += sum(model["look"][v][values[i]] for v in html_extract.looks(tree, i) if v in model["look"])
        out += model["turn"]["framed" if tree.framed[tree.parents[i]] else ""][values[tree.parents[i]]][values[i]]
    return out


def page(rng: random.Random, left: int) -> str:
    """A random page of so many block elements."""
    def part() -> str:
        nonlocal left
        out = ""
        while left and rng.random() < 0.7:
            left -= 1
            tag = rng.choice(["div", "p", "section", "ul", "nav", "article", "header", "script", "form"])
            cue = rng.choice(["", "", ' class="comments"', ' class="content"', ' id="sidebar"'])
            words = rng.choice(["", "one two.", SENTENCES, '<a href="/">link</a>'])
            out += f"<{tag}{cue}>{words}{part() if tag != 'p' else ''}</{tag}>"
        return out

    return part()


def test_marginals_against_all_labellings(model):
    rng, seen = random.Random(8), 0
    while seen < 60:
        tree = Tree(page(rng, 10))
        n = len(tree.tags)
        if not 3 <= n <= 11:
            continue
        seen += 1
        weights = {v: joint(tree, model, v) for v in itertools.product((0, 1), repeat=n) if not v[0] and not any(x and h for x, h in zip(v, tree.hidden))}
        most = max(weights.values())
        total = sum(math.exp(w - most) for w in weights.values())
        for i, got in enumerate(html_extract.marginals(tree, model)):
            want = sum(math.exp(w - most) for v, w in weights.items() if v[i]) / total
            assert abs(got - want) < 1e-9


def test_an_element_as_likely_as_not_is_left_out():
    even = {"turn": {k: [[math.log(0.5)] * 2] * 2 for k in ("", "framed")}, "look": {}}
    tree = Tree("<p>text</p>")
    assert html_extract.marginals(tree, even)[1] == 0.5 and html_extract.extract_page("<p>text</p>", even) == ""


def test_repeated_and_very_long_pages(spark, model):
    long = "<article><h1>Flood</h1>" + "".join(f"<p>{SENTENCES} {k}.</p>" for k in range(3000)) + "</article>"
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (3, None, None), (4, "", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 5 and texts[1] == texts[2] and texts[1].count("\n") == 3000 and texts[1].endswith("2999.") and texts[3] == texts[4] == ""


def test_vectors_with_large_components_take_part(spark):
    big = 2.0**45
    rows = [(0, [big, 1.0]), (1, [1.0, 2.0]), (2, [0.5, -big]), (3, [float("inf"), 0.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in vector_search.top_k(df, df.filter("vec_id = 20")).collect()}
    assert got == {(20, i): 64 * int(64 * a) + 64 * int(64 * b) for i, (a, b) in ((0, (big, 1)), (1, (1, 2)), (2, (0.5, -big)))}
