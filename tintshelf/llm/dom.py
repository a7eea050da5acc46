"""A small DOM for main-text extraction: tolerant parsing, node features, blocks of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never text of a page: code, drawings, controls, what a formula's source says besides its signs.
SILENT = {"script", "style", "head", "title", "template", "svg", "iframe", "select", "textarea", "button", "annotation", "annotation-xml"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Start tags that end an open element of these kinds, looked for up to the nearest of the stops.
_P = (frozenset({"p"}), frozenset({"table", "td", "th", "button"}))
CLOSES = {t: _P for t in BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}} | {
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
}
#: Elements whose content follows the rules of XML, and those inside them whose content is HTML again.
FOREIGN = {"svg", "math"}
HTML_AGAIN = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words in class, id and role that hint at what a node is for.
HINTS = {
    "content": {"article", "content", "post", "entry", "main", "story", "body", "text", "prose", "page"},
    "comment": {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "discussion", "feedback", "reviews"},
    "menu": {"nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc", "pager", "pagination", "tabs", "links"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "adsense", "doubleclick"},
    "side": {"sidebar", "side", "aside", "widget", "widgets", "related", "recommended", "rail", "complementary", "trending", "teaser"},
    "foot": {"footer", "foot", "copyright", "legal", "colophon", "contentinfo", "imprint"},
    "head": {"header", "masthead", "branding", "logo", "topbar", "toolbar"},
    "notice": {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "privacy", "message", "warning"},
    "share": {"share", "social", "sharing", "follow", "tweet", "facebook", "meta", "byline", "tags"},
    "form": {"form", "search", "login", "signup", "subscribe", "newsletter", "register", "contact"},
}
_TAGS = ["article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "li", "a", "table", "blockquote", "figure"]
FEATURES = [
    *[f"tag_{t}" for t in _TAGS], "tag_heading", "depth", "children", "sibling_rank", "siblings", "siblings_alike",
    "chars", "density", "link_share", "stop_share", "paragraphs", "chars_share", "chars_before",
    *[f"own_{h}" for h in HINTS], *[f"up_{h}" for h in HINTS], *[f"in_{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form")],
]


class Node:
    __slots__ = ("attrs", "children", "foreign", "hints", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.foreign = tag in FOREIGN or (parent is not None and parent.foreign and tag not in HTML_AGAIN)
        words = {w.lower() for k in ("class", "id", "role") if attrs.get(k) for w in _WORDS.findall(attrs[k])} if attrs else ()
        self.hints = [bool(words) and not v.isdisjoint(words) for v in HINTS.values()] if words else None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, stops = CLOSES.get(tag, (None, None))
        if ends:
            n, last = self.at, None
            while n is not None and n.tag not in stops:
                if n.tag in ends:
                    last = n
                n = n.parent
            if last is not None:
                self.at = last.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        closed = tag in FOREIGN or self.at.foreign
        self.handle_starttag(tag, attrs)
        if closed and tag not in VOID:  # as in HTML, the slash closes nothing else
            self.at = self.at.parent

    def parse_html_declaration(self, i):
        low = self.rawdata[i : i + 9].lower()
        if low.startswith("<!--") or low == "<!doctype":
            return super().parse_html_declaration(i)
        if low == "<![cdata[" and self.at.foreign:
            start, stop = i + 9, self.rawdata.find("]]>", i + 9)
            if stop >= 0:
                self.handle_data(self.rawdata[start:stop])
                return stop + 3
        return self.parse_bogus_comment(i)  # marked sections are none in HTML

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            if tag not in BLOCK and n.tag in BLOCK:  # a stray inline end tag ends no block
                return
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; null or empty text is a root without children, unclosed elements end where they must."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def nodes(root: Node) -> list[Node]:
    """All speaking elements in page order, without recursion."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in SILENT]
    return out


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Speaking elements and their features; text statistics are summed from the leaves up."""
    order = nodes(root)
    index = {id(n): i for i, n in enumerate(order)}
    m = len(order)
    own = np.zeros((m, 5))  # characters, of links, tags, stops, paragraphs
    parent = np.full(m, -1)
    up = np.zeros((m, len(HINTS)), dtype=bool)
    inside = np.zeros((m, 8), dtype=bool)  # the last: in a link
    x = np.zeros((m, len(FEATURES)), dtype=np.float64)
    names = {t: i for i, t in enumerate(_TAGS)}
    areas = {t: i for i, t in enumerate(("article", "main", "nav", "header", "footer", "aside", "form", "a"))}
    base = len(_TAGS)
    before, chars = np.zeros(m), 0
    for i, n in enumerate(order):
        p = index[id(n.parent)] if n.parent is not None else -1
        parent[i] = p
        row = x[i]
        if p >= 0:
            up[i] = up[p]
            if order[p].hints:
                up[i] |= order[p].hints
            inside[i] = inside[p]
            row[base + 1] = x[p, base + 1] + 1
        if n.tag in areas:
            inside[i, areas[n.tag]] = True
        if n.tag in names:
            row[names[n.tag]] = 1
        elif len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit():
            row[base] = 1
        kinds: dict[str, int] = {}
        elements = 0
        before[i] = chars
        for c in n.children:
            if isinstance(c, str):
                size = len(c.strip())
                chars += size
                own[i, 0] += size
                own[i, 3] += c.count(".") + c.count(",")
            elif c.tag not in SILENT:
                elements += 1
                kinds[c.tag] = kinds.get(c.tag, 0) + 1
        own[i, 2] = 1
        own[i, 4] = n.tag == "p"
        if inside[i, 7]:
            own[i, 1] = own[i, 0]
        row[base + 2] = elements
        k = 0
        for c in n.children:
            if isinstance(c, Node) and c.tag not in SILENT:
                j = index[id(c)]
                x[j, base + 3], x[j, base + 4], x[j, base + 5] = k / elements, elements, kinds[c.tag]
                k += 1
    for i in range(m - 1, 0, -1):  # children come after their parents
        own[parent[i]] += own[i]
    total = max(own[0, 0], 1.0)
    at = base + 6
    size = np.maximum(own[:, 0], 1)
    x[:, at] = np.log1p(own[:, 0])
    x[:, at + 1] = own[:, 0] / own[:, 2]
    x[:, at + 2] = own[:, 1] / size
    x[:, at + 3] = own[:, 3] / size
    x[:, at + 4] = own[:, 4]
    x[:, at + 5] = own[:, 0] / total
    x[:, at + 6] = before / total
    at += 7
    for i, n in enumerate(order):
        if n.hints:
            x[i, at : at + len(HINTS)] = n.hints
    at += len(HINTS)
    x[:, at : at + len(HINTS)] = up
    x[:, at + len(HINTS) :] = inside[:, :7]
    return order, x


def block_texts(root: Node, kept: set[int]) -> list[str]:
    """Texts of the blocks in page order that stand in kept elements (ids of nodes); white space runs become one blank."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    stack: list[tuple[bool, Node | str]] = [(True, root)]
    keep = [False]
    while stack:
        opens, n = stack.pop()
        if not opens:
            if n.tag in BLOCK:
                flush()
            keep.pop()
        elif isinstance(n, str):
            if keep[-1]:
                now.append(n)
        elif n.tag == "br":
            now.append(" ")
        elif n.tag not in SILENT:
            if n.tag in BLOCK:
                flush()
            keep.append(id(n) in kept)
            stack.append((False, n))
            stack += [(True, c) for c in reversed(n.children)]
    flush()
    return out
