"""A tolerant HTML parser that makes a flat node list, as far as main-text extraction needs it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of HTML: elements without content, with raw text, without rendering, and those that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th caption button object".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


@dataclass
class Tree:
    """Nodes in page order: parents come before their children; node 0 is the root. A text node has the tag "#"."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])

    def add(self, tag: str, parent: int, attributes: str = "", text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.text.append(text)
        return len(self.tag) - 1


def attribute_text(raw: str) -> str:
    """Names and values that say what an element is for: class, id, role, hidden and the like."""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            out.append(a or b or c)
        elif name == "hidden" or name == "aria-hidden" and (a or b or c) == "true" or name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            out.append("hidden")
    return " ".join(out)


class Scanner:
    """Finds tags from left to right. What a search has found missing in the rest of a page is never searched for again, so a page takes linear time."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the `>` of a tag is whose attributes begin at `at`; quoted values may hold one. A quote that nothing closes counts as a character."""
        first = self.find(">", at)
        if first < 0:
            return -1
        while m := _QUOTED.search(self.page, at):
            if m[0] == ">":
                return m.start()
            closed = self.find(m[0], m.end())
            if closed < 0:
                return self.find(">", m.end())
            if "=" not in self.page[max(0, m.start() - 8) : m.start()] or self.find(">", closed) < 0:
                return first
            at = closed + 1
        return first

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, "/" or "", name, attributes) of the next tag, comment or declaration (these have no name); a `<` that begins none is text."""
        while (begin := self.page.find("<", at)) >= 0:
            if self.page.startswith("<!--", begin):
                end = self.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(self.page), "", "", ""
            if self.page.startswith(("<!", "<?"), begin) and (end := self.find(">", begin)) >= 0:
                return begin, end + 1, "", "", ""
            if self.find(">", begin) < 0:  # no tag ends any more
                at = begin + 1
                continue
            if (m := _NAME.match(self.page, begin)) and (end := self.tag_end(m.end())) >= 0:
                return begin, end + 1, m[1], m[2].lower(), self.page[m.end() : end]
            at = begin + 1
        return None


def parse(page: str) -> Tree:
    """The node list of a page. Never fails: stray ends are passed over, what is left open ends with the page."""
    tree = Tree()
    tag = tree.tag
    stack = [0]
    formats: list[str] = []  # formatting elements that a closed block took with it
    at, n, scan = 0, len(page), Scanner(page)
    ends: dict[str, bool] = {}
    while at < n:
        found = scan.next(at)
        begin, after, slash, name, raw = found or (n, n, "", "", "")
        if begin > at:
            text = unescape(page[at:begin])
            if text.strip():
                if formats:
                    for f in formats:
                        stack.append(tree.add(f, stack[-1]))
                    formats = []
                tree.add("#", stack[-1], "", text)
            elif tag[-1] == "#":
                tree.text[-1] += " " if tree.parent[-1] == stack[-1] else ""
            else:
                tree.add("#", stack[-1], "", " ")
        if not found:
            break
        at = after
        if not name:
            continue
        if slash:
            formats = [f for f in formats if f != name]
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == name:
                    if name in BLOCK:
                        formats = []
                    del stack[k:]
                    break
                if tag[stack[k]] in SCOPE and name not in SCOPE:
                    break
            continue
        if name in BLOCK:
            _close(tag, stack, {"p"}, SCOPE, formats)
        if name in CLOSES:
            _close(tag, stack, *CLOSES[name], [])
        node = tree.add(name, stack[-1], attribute_text(raw) if raw else "")
        if name in RAW:
            end = None if ends.get(name) else _RAW_END[name].search(page, at)
            ends[name] = end is None
            stop = end.start() if end else n
            tree.add("#", node, "", unescape(page[at:stop]) if name in ("title", "textarea") else page[at:stop])
            at = close + 1 if end and (close := scan.find(">", stop)) >= 0 else n
        elif name not in VOID and not raw.endswith("/") or name in ("p", "div", "span", "a"):
            stack.append(node)
    return tree


def _close(tag: list[str], stack: list[int], which: set[str] | frozenset[str], until: set[str] | frozenset[str], formats: list[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if tag[stack[k]] in which:
            formats += [tag[x] for x in stack[k + 1 :] if tag[x] in FORMATTING and tag[x] != "a"]
            del stack[k:]
            return
        if tag[stack[k]] in until:
            return
