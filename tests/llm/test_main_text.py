import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import html
from skerry.llm.dom import parse


def test_held_out_pages():
    rng = np.random.default_rng(1234)
    made = [html.made_page(rng) for _ in range(150)]
    got = html.extract([p for p, _ in made], html.model())
    assert sum(g == t for g, (_, t) in zip(got, made, strict=True)) >= 0.92 * len(made)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now. Cheap things, all day.</div>
<article><h1>A  title &amp; more</h1><p><b>First &eacute; paragraph of text,
 with words.<br><p>Second one, that is longer and has <a href="x">a link</a> in it.</p><p>Third &lt;b&gt; one. It goes on and on.</p></article>
<div id="comments"><p>I disagree with all of this.</p></div><footer>&copy; someone</footer>"""


def test_page(spark):
    want = "A title & more\nFirst é paragraph of text, with words.\nSecond one, that is longer and has a link in it.\nThird <b> one. It goes on and on."
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<<<>>> < b <p <div"), (None, "x", PAGE), (1, "u", PAGE), (5, "y", "<script>var a = 1;</script><style>p{}</style>"), (6, "z", PAGE.replace("Third", "Third " + "word " * 30_000))]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.main_text(pages).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == len(rows)
    assert by[1, "u"].text == by[None, "x"].text == want and by[1, "u"].n_chars == len(want)
    assert by[2, None].text == by[3, "v"].text == by[5, "y"].text == ""
    assert by[6, "z"].text.count("word ") > 29_000
    assert html.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<a b='", '<div class="x', "<p <p ", "<!-- ", "<!x ", "<script>", "<b></b", "<a x=\"1'>", "<textarea", "< < <", "</", "<p a='1' b=\"2>"])
def test_malformed_pages_take_linear_time(part):
    def took(n):
        began = time.process_time()
        tree = parse(part * n)
        assert all(p < i for i, p in enumerate(tree.parent))
        return time.process_time() - began

    assert took(40_000) < 2 + 14 * took(8_000)


def test_tags_and_quotes():
    tree = parse("<p title='a>b' class=\"x > y\">one<p class=it's>two < three<div id=\"open>four</div>")
    assert "".join(tree.text) == "onetwo < threefour" and tree.attributes[1] == "x > y"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "word", " ", "<br>", "<li>", "</ul>", "<ul>", "&amp;", "<a href='x>y'>", "</a>", "<td>", "<!-- x", "<script>", "</script>"]), max_size=25))
def test_parser_takes_anything(parts):
    tree = parse("".join(parts))
    assert all(p < i for i, p in enumerate(tree.parent))
    html.extract(["".join(parts)], html.model())


@pytest.mark.parametrize("seed", range(20))
def test_decoding_is_the_best_labelling(seed):
    rng = np.random.default_rng(seed)
    tree = parse("<div><p>one two</p><div>three<p>four</p></div><ul><li>five</li></ul></div>")
    margin = rng.normal(0, 2, len(tree.tag))
    nodes = [i for i, t in enumerate(tree.tag) if t != "#" and i]
    own = np.zeros(len(tree.tag))
    for i, t in enumerate(tree.tag):
        if t == "#":
            own[tree.parent[i]] += len(tree.text[i].split()) ** 0.5
    gain = (own + 0.05) * margin
    best, states = -1.0, None
    for labels in itertools.product("oic", repeat=len(nodes)):
        state = dict(zip(nodes, labels, strict=True)) | {0: "o"}
        if any(s != "c" and state[tree.parent[i]] == "c" or s == "o" and state[tree.parent[i]] == "i" for i, s in state.items() if i):
            continue
        worth = sum(gain[i] for i in nodes if state[i] == "i") - sum(html.ENTER if (s, state[tree.parent[i]]) == ("i", "o") else html.CUT if (s, state[tree.parent[i]]) == ("c", "i") else 0 for i, s in state.items() if i)
        if worth > best + 1e-9:
            best, states = worth, state
    keep = html.decode(tree, margin)
    got = sum(gain[i] for i in nodes if keep[i]) - sum(html.ENTER if keep[i] and not keep[tree.parent[i]] else html.CUT if not keep[i] and keep[tree.parent[i]] else 0 for i in nodes)
    assert states is None or abs(got - best) < 1e-9 or (best <= 0 and not keep.any())
