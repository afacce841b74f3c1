"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

Each element gets features: its kind and its parent's, text, link and tag counts of its subtree and their densities, tokens of its class, id and role and those
of its ancestors, depth, place among its siblings and what those are like. Boosted trees give the log odds that an element is main
text. Decoding picks for each element one of three states by dynamic programming over the tree: outside (its children choose), inside (main text, its children
are inside or cut), cut (all below is cut). So no element is main text below a cut one, and main text is a few subtrees.

There are no labels for pages, so the trees learn from PAGES pages that `made_page` composes at random: articles, with menus, headers, footers,
sidebars, notices, adverts, forms, comments and share bars around and within them, under many names or none. Defined results: null and empty
pages give the empty text; scripts, styles and markup never give text; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.boosting import Trees, boost
from skerry.llm.common import arrow
from skerry.llm.dom import BLOCK, RAW, Tree, parse

PAGES, SEED = 700, 5
#: Decoding: price of entering main text, of cutting within it.
ENTER, CUT = 1.0, 1.0

KINDS = ["article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "p", "ul", "ol", "li", "table", "td", "h1", "h2", "h3", "a", "span", "blockquote", "pre", "figure", "button", "label", "select", "body"]
# Parts of class, id and role names, by what they tell.
GOOD = re.compile(r"article|content|main|post|body|entry|story|text|prose|blog|read", re.I)
NAMES = [
    re.compile(r"nav|menu|breadcrumb|crumb|toc\b|pager|pagination|tabs|topbar|toolbar", re.I),
    re.compile(r"head|masthead|brand|logo|hero", re.I),
    re.compile(r"foot|copyright|legal|colophon|imprint", re.I),
    re.compile(r"side|aside|rail|widget|related|recommend|trending|popular|latest|more-", re.I),
    re.compile(r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|promo|banner|affiliate|dfp|outbrain|taboola", re.I),
    re.compile(r"cookie|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscribe|signup|paywall|toast|warning", re.I),
    re.compile(r"comment|disqus|reply|replies|respond|discussion|reader|feedback", re.I),
    re.compile(r"share|social|follow|like|tweet|facebook", re.I),
    re.compile(r"form|search|login|contact|poll|input|subscribe", re.I),
    re.compile(r"hidden|sr-only|screen-reader", re.I),
]
ALWAYS_OUT = RAW | {"head", "button", "select", "input", "svg", "canvas", "audio", "video", "object", "template", "datalist", "math"}


def features(tree: Tree) -> np.ndarray:
    """A row for each node; text nodes have their parents' counts and are never decoded themselves."""
    n = len(tree.tag)
    parent = np.array(tree.parent)
    tag = tree.tag
    text, links, stops, commas, tags, paras, depth = (np.zeros(n) for _ in range(7))
    is_text = np.array([t == "#" for t in tag])
    kinds = {k: i + 1 for i, k in enumerate(KINDS)}
    kind = np.array([kinds.get(t, 0) for t in tag])
    for i in np.flatnonzero(is_text).tolist():
        if tag[parent[i]] not in RAW:
            t = tree.text[i]
            text[i], stops[i], commas[i] = len(t.split()), t.count(".") + t.count("!") + t.count("?"), t.count(",")
    tags[~is_text] = 1
    paras[kind == kinds["p"]] = 1
    names = np.zeros((n, len(NAMES) + 1))
    for i, a in enumerate(tree.attributes):
        if a:
            names[i] = [bool(p.search(a)) for p in (GOOD, *NAMES)]
    above = np.zeros_like(names)
    in_kind = np.zeros((n, 5))  # article or main, nav, header, footer, aside or form above
    own = np.stack([np.isin(kind, [kinds[k] for k in ks]) for ks in (("article", "main"), ("nav",), ("header",), ("footer",), ("aside", "form"))], axis=1).astype(float)
    children = np.bincount(parent[1:], minlength=n).astype(float)
    order = np.zeros(n)
    seen = np.zeros(n)
    same = np.zeros(n)
    par = parent.tolist()
    for i in range(1, n):
        p = par[i]
        depth[i] = depth[p] + 1
        order[i] = seen[p]
        seen[p] += 1
        above[i] = np.maximum(above[p], names[p]) if p else names[p]
        in_kind[i] = np.maximum(in_kind[p], own[p])
    counts: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        counts[par[i], tag[i]] = counts.get((par[i], tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = counts[par[i], tag[i]]
    for i in range(n - 1, 0, -1):
        p = par[i]
        if tag[i] == "a":
            links[i] = text[i]
        for v in (text, links, stops, commas, tags, paras):
            v[p] += v[i]
    whole = max(text[0], 1)
    words = np.maximum(text, 1)
    beside = text[np.maximum(parent, 0)] - text
    columns = [
        kind, kind[np.maximum(parent, 0)], np.minimum(depth, 30), np.log1p(text), text / whole, links / words, text / np.maximum(tags, 1), stops / words, commas / words, paras, np.log1p(tags), children,
        order, order / np.maximum(children[np.maximum(parent, 0)], 1), same, np.log1p(np.maximum(beside, 0)), beside / whole, links[np.maximum(parent, 0)] / np.maximum(text[np.maximum(parent, 0)], 1), np.cumsum(np.where(is_text, text, 0)) / max(whole, 1),
        *names.T, *above.T, *in_kind.T,
    ]
    return np.stack(columns, axis=1)


def decode(tree: Tree, margin: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the best labelling in which nothing is inside below a cut element."""
    n = len(tree.tag)
    own = np.zeros(n)
    parent = tree.parent
    for i in range(1, n):
        if tree.tag[i] == "#":
            own[parent[i]] += max(0.2, min(len(tree.text[i].split()), 40) ** 0.5) if tree.text[i].strip() else 0.0
    gain = own * np.clip(margin, -6, 6) + 0.05 * np.clip(margin, -6, 6)
    barred = [t in ALWAYS_OUT for t in tree.tag]
    inside, outside = [0.0] * n, [0.0] * n  # worth of the subtree; cut is worth 0
    for i in range(n - 1, 0, -1):
        if tree.tag[i] == "#":
            continue
        if barred[i]:
            inside[i] = -1e9
            outside[i] = 0.0
        else:
            inside[i] += gain[i]
        p = parent[i]
        inside[p] += max(inside[i], -CUT if not barred[i] else 0.0)
        outside[p] += max(outside[i], inside[i] - ENTER, 0.0)
    state = [0] * n  # 0 outside, 1 inside, 2 cut
    for i in range(1, n):
        up = state[parent[i]]
        if tree.tag[i] == "#":
            state[i] = 1 if up == 1 else 2
        elif up == 2:
            state[i] = 2
        elif up == 1:
            state[i] = 1 if inside[i] >= (-CUT if not barred[i] else 0.0) else 2
        else:
            state[i] = 1 if inside[i] - ENTER > outside[i] and inside[i] - ENTER > 0 else (0 if outside[i] > 0 else 2)
    return np.array(state) == 1


def blocks(tree: Tree, keep: np.ndarray) -> str:
    """The kept text, blocks on lines of their own, white space within a block as one space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(held).split()):
            out.append(line)
        held.clear()

    block_of = [0] * len(tree.tag)
    last = 0
    for i in range(1, len(tree.tag)):
        p = tree.parent[i]
        if tree.tag[i] in BLOCK:
            block_of[i] = i
            flush()
            last = i
            continue
        block_of[i] = block_of[p]
        if block_of[i] != last:
            flush()
            last = block_of[i]
        if tree.tag[i] == "br":
            held.append(" ")
        elif tree.tag[i] == "#" and keep[i]:
            held.append(tree.text[i])
    flush()
    return "\n".join(out)


#: Pages whose nodes are scored together.
TOGETHER = 64


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    out = []
    for a in range(0, len(pages), TOGETHER):
        parsed = [parse(p or "") for p in pages[a : a + TOGETHER]]
        margins = trees.margin(np.vstack([features(t) for t in parsed]))
        ends = np.cumsum([len(t.tag) for t in parsed]).tolist()
        out += [blocks(t, decode(t, margins[e - len(t.tag) : e])) for t, e in zip(parsed, ends, strict=True)]
    return out


# ---- pages to learn from


def made_page(rng: np.random.Generator) -> tuple[str, str]:
    """A random page, and its main text."""
    syllables = ["ka", "lo", "mi", "ren", "ta", "su", "ver", "on", "di", "pel", "qua", "ness"]
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda n: " ".join(word() for _ in range(max(1, n)))

    def sentences(n: int) -> str:
        style = rng.random()
        s = [words(int(rng.integers(1, 18))) for _ in range(n)]
        if style < 0.1:
            return " | ".join(words(1) for _ in range(4 * n))
        if style < 0.15:
            return " ".join(w + pick("***", "$$$", "%%%") for x in s for w in x.split())
        return " ".join(x.capitalize() + (", " + word() if rng.random() < 0.3 else "") + "." for x in s)

    def named(tag: str, names: list[str], inner: str, plain: float = 0.25) -> str:
        if rng.random() < plain:
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {pick("class", "class", "id")}="{pick(*names)}">{inner}</{tag}>'

    def link_list(n: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>"

    def menu() -> str:
        return pick(lambda: named("nav", ["nav", "main-menu", "navbar"], link_list(int(rng.integers(2, 9))), 0.6), lambda: named("div", ["menu", "navigation", "nav-bar", "breadcrumbs"], link_list(int(rng.integers(2, 9))), 0.05))()

    def header() -> str:
        return named("header", ["header", "masthead", "site-header"], f"<h2>{words(2)}</h2>" * int(rng.random() < 0.5) + f"<p>{words(5)}</p>" + menu() * int(rng.random() < 0.5), 0.5)

    def footer() -> str:
        return named("footer" if rng.random() < 0.75 else "div", ["footer", "site-footer", "copyright", "legal"], f"&copy; {word()}.example.com &middot; {sentences(int(rng.integers(1, 4)))}" + link_list(3) * int(rng.random() < 0.3), 0.05 if rng.random() < 0.3 else 0.6)

    def advert() -> str:
        return f'<div class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement")}">{sentences(int(rng.integers(1, 5)))}</div>'

    def notice() -> str:
        return f'<{(t := pick("div", "section", "aside"))} class="{pick("cookie-notice", "notice", "consent", "alert", "newsletter", "cookie-banner", "popup", "gdpr")}"><p>{sentences(int(rng.integers(1, 4)))}</p>{"<button>OK</button>" * int(rng.random() < 0.5)}</{t}>'

    def sidebar() -> str:
        inner = f"<h3>{words(2)}</h3>" + (link_list(int(rng.integers(2, 7))) if rng.random() < 0.6 else f"<p>{sentences(int(rng.integers(1, 5)))}</p>")
        return named("aside", ["sidebar", "related", "widget"], inner, 0.5) if rng.random() < 0.6 else named("div", ["sidebar", "side-col", "related-posts", "widget", "right-rail"], inner, 0.0)

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(2)}</label><input name="q"><p>{sentences(1)}</p><select><option>{word()}</option></select><button>{word()}</button></form>'

    def comments() -> str:
        one = lambda: pick(lambda: f'<div class="comment"><b>{word()}</b><p>{sentences(int(rng.integers(1, 6)))}</p></div>', lambda: f"<li><p>{word()}:</p><p>{sentences(int(rng.integers(1, 6)))}</p></li>")()
        return f'<{(t := pick("section", "div", "div"))} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "responses", "reader-comments")}"><h3>{words(2)}</h3>{"".join(one() for _ in range(int(rng.integers(1, 6))))}</{t}>'

    def share() -> str:
        return f'<div class="{pick("share", "social", "share-bar")}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>'

    out: list[str] = []
    body: list[str] = []

    def keep(tag: str, text: str, close: bool = True) -> str:
        out.append(" ".join(text.split()))
        w = text.split(" ")
        if len(w) > 6 and rng.random() < 0.3:
            a = int(rng.integers(len(w) - 2))
            w[a] = f"<{(t := pick('b', 'em', 'a href="/x"', 'span'))}>{w[a]}</{t.split()[0]}>"
        inner = " ".join(w)
        if rng.random() < 0.1:
            inner = "<b>" + inner + "<br>"
            close = False
        return f"<{tag}>{inner}" + (f"</{tag}>" if close else "")

    if rng.random() < 0.85:
        body.append(keep("h1", words(int(rng.integers(2, 12)))))
    for _ in range(int(rng.integers(1, 14)) if rng.random() < 0.9 else int(rng.integers(14, 40))):
        r = rng.random()
        if r < 0.75:
            body.append(keep("p", sentences(int(rng.integers(1, 9)) if rng.random() < 0.8 else 1), rng.random() < 0.95))
        elif r < 0.8:
            body.append(keep("h2", words(int(rng.integers(1, 7)))))
        elif r < 0.84:
            body.append("<ul>" + "".join(keep("li", sentences(1)) for _ in range(int(rng.integers(2, 6)))) + "</ul>")
        elif r < 0.87:
            body.append("<blockquote>" + keep("p", sentences(2)) + "</blockquote>")
        elif r < 0.89:
            body.append("<table><tr>" + "".join(keep("td", words(3)) for _ in range(3)) + "</tr></table>")
        else:
            body.append(pick(advert, share, notice, form, sidebar)())
    inner = "".join(body)
    if rng.random() < 0.15:
        inner += comments()
    shape = rng.random()
    if shape < 0.45:
        main = named("article", ["post", "article", "story"], inner, 0.6)
    elif shape < 0.6:
        main = named("main", ["main", "content"], inner, 0.5)
    elif shape < 0.9:
        main = f'<div {pick("class", "id")}="{pick("content", "article-body", "post-content", "entry", "main", "story-text", "article")}">{inner}</div>'
    else:
        main = f"<div>{inner}</div>"
    before = [f() for f in (menu, header, notice, advert, share, form) if rng.random() < 0.4]
    after = [f() for f in (footer, sidebar, comments, advert, form, notice, share) if rng.random() < (0.75 if f is footer else 0.35)]
    rng.shuffle(before)
    if rng.random() < 0.5:
        rng.shuffle(after)
    page = "".join(before) + main + "".join(after)
    if rng.random() < 0.3:
        page = f'<div class="{pick("wrapper", "container", "page", "site")}">{page}</div>'
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    return f"{head}<body>{page}" + ("</body></html>" if rng.random() < 0.9 else ""), "\n".join(out)


@lru_cache(1)
def model(pages: int = PAGES, seed: int = SEED) -> Trees:
    """Fits the trees. A node's label is whether the text right below it is main text; nodes without own text take their subtree's, unless it is mixed."""
    rng = np.random.default_rng(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page, main = made_page(rng)
        tree = parse(page)
        wanted = _marked(tree, main)
        x = features(tree)
        n = len(tree.tag)
        good, bad, direct = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        for i in range(n - 1, 0, -1):
            if tree.tag[i] == "#" and tree.text[i].strip() and tree.tag[tree.parent[i]] not in RAW:
                direct[tree.parent[i]] = True
                (good if wanted[i] else bad)[i] += len(tree.text[i].split())
            good[tree.parent[i]] += good[i]
            bad[tree.parent[i]] += bad[i]
        label = good > bad
        use = np.array([t not in ("#", "#root") and t not in ALWAYS_OUT for t in tree.tag]) & (good + bad > 0) & (direct | (good == 0) | (bad == 0))
        xs.append(x[use])
        ys.append(label[use].astype(float))
        ws.append(np.where(direct[use], 1.0, 0.3))
    return boost(np.vstack(xs), np.concatenate(ys), np.concatenate(ws))


def _marked(tree: Tree, main: str) -> np.ndarray:
    """Which text nodes are main text: those whose block is the next line of it."""
    lines = main.split("\n")
    out = np.zeros(len(tree.tag), bool)
    at, i, n = 0, 1, len(tree.tag)
    block_of = [0] * n
    groups: list[list[int]] = []
    last = -1
    for i in range(1, n):
        if tree.tag[i] in BLOCK:
            block_of[i], last = i, -1
            continue
        block_of[i] = block_of[tree.parent[i]]
        if tree.tag[i] == "#" and tree.tag[tree.parent[i]] not in RAW:
            if block_of[i] != last:
                groups.append([])
                last = block_of[i]
            groups[-1].append(i)
    for group in groups:
        if at < len(lines) and " ".join("".join(tree.text[i] for i in group).split()) == lines[at]:
            out[group] = True
            at += 1
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, text, n_chars)."""
    arrow(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract(batch.column("html").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
