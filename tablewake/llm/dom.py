"""Block trees of HTML pages and the features of their nodes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Fixed values of HTML: elements without content, without text to read, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template title svg iframe object canvas audio video".split())
#: Of these, the ones that may hold their like.
NESTING = frozenset("template svg object canvas audio video".split())
#: What may stand in a head: anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: A slash at the end of the tag closes these only.
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input "
    # A formula is part of its line.
    "math maction menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
#: What an opening tag closes if it is open, and what bounds the search.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
    "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
}

#: Words of class, id and role names, by what they are used for; tags stand for the same.
GROUPS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav toc pagination pager links",
    "header": "header masthead topbar brand logo site",
    "footer": "footer foot copyright colophon legal contentinfo",
    "sidebar": "sidebar aside side rail widget widgets complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning paywall banner",
    "advert": "ad ads advert advertisement adsense promo promotion sponsor sponsored",
    "form": "form login signup signin subscribe subscription newsletter search contact",
    "comment": "comment comments reply replies respond disqus discussion feedback reader",
    "related": "share sharing social related recommended recommendations trending popular tags",
    "content": "article content post entry main story body text prose maincontent",
}
_GROUP = {word: k for k, words in enumerate(GROUPS.values()) for word in words.split()}
_TAG_GROUP = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "dialog": 4, "form": 6, "fieldset": 6, "select": 6, "button": 6, "textarea": 6, "article": 9, "main": 9}
_KINDS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "li": 2, "ul": 3, "ol": 3, "td": 4, "table": 4, "tr": 4, "div": 5, "section": 5, "#text": 6}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = 15 + 8 + 2 * len(GROUPS)


class Node:
    __slots__ = ("tag", "parent", "children", "text", "link", "groups", "marks", "parts", "label")

    def __init__(self, tag: str, parent: Node | None, groups: int = 0, marks: str = "") -> None:
        self.tag, self.parent, self.groups, self.marks = tag, parent, groups, marks
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.text, self.link, self.label = "", 0, 0


class _Builder(HTMLParser):
    """Block elements become nodes; a line's text becomes a ``#text`` node of the block it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.line: Node | None = None
        self.silent: list[str] = []
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            # What cannot stand in a head ends one that was left open; a body also ends what was left open in it.
            if self.silent == ["head"] and tag not in IN_HEAD or self.silent[0] == "head" and tag == "body":
                self.silent = []
            elif tag == self.silent[-1] and tag in NESTING or self.silent == ["head"] and tag in SILENT and tag != "head":
                self.silent.append(tag)
        if self.silent:
            return
        if tag in SILENT:
            self.silent.append(tag)
        elif tag in INLINE:
            if tag == "a":
                self.links += 1
            elif tag in ("br", "img", "input"):
                self.handle_data(" ")
        elif tag not in ("html", "body"):
            self._end_line()
            self.links = 0
            self._close_open("p", ())
            if tag in CLOSES:
                names, bounds = CLOSES[tag]
                self._close_open(names, bounds)
            groups, marks = 1 << _TAG_GROUP[tag] if tag in _TAG_GROUP else 0, ""
            for name, value in attrs:
                if name in ("class", "id", "role") and value:
                    for word in _WORDS.findall(value):
                        k = _GROUP.get(word.lower())
                        groups |= 1 << k if k is not None else 0
                elif name == "data-truth":
                    marks = value
            node = Node(tag, self.at, groups, marks)
            self.at.children.append(node)
            if tag not in VOID:
                self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # In HTML itself the slash has no meaning.
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE and tag not in ("html", "body"):
            self._end_line()
            # A paragraph's end does not close what stands around it.
            self._close_open(tag, () if tag != "p" else ("div", "article", "section", "td", "li", "body"), inner=True)

    def handle_data(self, data: str) -> None:
        # Text ends a head that was left open, too.
        if self.silent == ["head"] and data.strip():
            self.silent = []
        if self.silent:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Node("#text", self.at)
            self.at.children.append(self.line)
        self.line.parts.append(data)
        if self.links:
            self.line.link += len(data)

    def _end_line(self) -> None:
        if self.line is not None:
            self.line.text = " ".join("".join(self.line.parts).split())
            self.line.parts = []
            self.line = None

    def _close_open(self, names: str, bounds: tuple, inner: bool = False) -> None:
        node, wanted = self.at, names.split()
        while node.parent is not None:
            if node.tag in wanted:
                self.at = node.parent
                return
            if node.tag in bounds or (not inner and node.tag not in wanted and names == "p"):
                return
            node = node.parent


def parse(html: str | None) -> Node:
    """The block tree of a whole page; character references are decoded, runs of white space in a line are one space."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder._end_line()
    return builder.root


def in_order(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node of a tree in order: depth, subtree density, link share, siblings, attribute words."""
    n = len(nodes)
    index = {id(node): k for k, node in enumerate(nodes)}
    parent = np.array([0] + [index[id(node.parent)] for node in nodes[1:]], np.int64)
    own = np.array([len(node.text) for node in nodes], np.float64)
    signs = np.array([sum(map(node.text.count, ".,;:!?")) for node in nodes], np.float64)
    total, blocks, link, depth, path = own.copy(), np.ones(n), np.array([node.link for node in nodes], np.float64), np.zeros(n), [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        total[p] += total[k]
        blocks[p] += blocks[k]
        link[p] += link[k]
        signs[p] += signs[k]
    path[0] = nodes[0].groups
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
        path[k] = path[parent[k]] | nodes[k].groups
    size = np.log1p(total)
    place, before, after, around, brothers = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    for node in nodes:
        if len(node.children) > 1:
            some = [index[id(c)] for c in node.children]
            place[some] = np.arange(len(some)) / len(some)
            before[some[1:]], after[some[:-1]] = size[some[:-1]], size[some[1:]]
            around[some], brothers[some] = size[some].mean(), len(some)
    out = np.zeros((n, FEATURES), np.float32)
    starts = np.cumsum(own) - own
    whole = max(1.0, total[0])
    many = np.maximum(1, total)
    columns = (depth, [len(x.children) for x in nodes], np.log1p(blocks), np.log1p(own), size, total / whole, link / many, total / blocks, signs / many, place, before, after, around, brothers, starts / whole)
    for k, column in enumerate(columns):
        out[:, k] = column
    rows = np.arange(n)
    kind = np.array([_KINDS.get(node.tag, 7) for node in nodes])
    # A line is of the kind of the block it fills.
    filled = np.array([node.tag == "#text" and len(node.parent.children) == 1 for node in nodes])
    kind = np.where(filled, kind[parent], kind)
    out[rows, len(columns) + kind] = 1
    own_groups = np.array([node.groups for node in nodes])
    for k in range(len(GROUPS)):
        out[:, len(columns) + 8 + k] = own_groups >> k & 1
        out[:, len(columns) + 8 + len(GROUPS) + k] = np.array(path) >> k & 1
    return out
