"""A small tolerant reader of HTML: a tree of elements with their text, and measures of each element."""

from __future__ import annotations

import html as references
import re

import numpy as np

_S = "[ \\t\\n\\f\\r]"
# A quote opens a value only after "="; elsewhere in a tag it is a sign like any other. A comment also ends with "--!>".
_ATTRIBUTES = rf"""(?:[/ \t\n\f\r]++|[^/> \t\n\f\r][^/>= \t\n\f\r]*+(?:{_S}*+={_S}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^>"' \t\n\f\r][^> \t\n\f\r]*+)?+)?+)*+"""
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^/> \t\n\f\r]*)({_ATTRIBUTES})(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title select".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr
noscript template svg tspan math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mpadded mphantom semantics annotation""".split())
# Within these, an element may end itself, and only the named ones end a paragraph around them.
FOREIGN = ("svg", "math")
LEAVES = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul".split())
# A select without an end holds its options only.
_NO_OPTION = re.compile(r"<(?!/?(?:option|optgroup|hr)\b)/?[a-zA-Z]", re.I)
# An element of the left is closed by a start of the right that finds it open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"thead", "tbody", "tfoot"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}}
BOUNDS = frozenset("ul ol dl table select article section main aside nav body html td th button".split())

MARKED = frozenset(["p", *CLOSES]) | BOUNDS

GOOD = frozenset("article content main body entry post text story prose blog page hentry markdown".split())
BAD = frozenset("""ad ads advert advertisement adverts aside banner bar breadcrumb breadcrumbs byline cookie cookies comment comments consent copyright disclaimer disqus
footer foot form header head legal login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination paywall popup privacy promo
promoted recommended related reply replies rss search share sharing shop sidebar side signup skip social sponsor sponsored subscribe tags teaser toc tool toolbar
tracking widget""".split())
BAD_TAGS = frozenset("nav aside footer header form button dialog menu fieldset figcaption".split())


class Node:
    """An element; ``parts`` are its texts and elements in order, ``mark`` is the nearest one, itself or above, that a start tag
    may close or that bounds its reach."""

    __slots__ = ("tag", "tokens", "parent", "parts", "depth", "number", "mark")

    def __init__(self, tag: str, tokens: frozenset, parent: Node | None):
        self.tag, self.tokens, self.parent, self.parts = tag, tokens, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.number = -1
        self.mark = self if tag in MARKED else parent.mark if parent else None


def _tokens(attributes: str) -> frozenset:
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            found.update(t.lower() for t in _TOKEN.findall(value))
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and "true" in value):
            found.add("#hidden")
    return frozenset(found)


def _raw_end(tag: str, html: str, at: int) -> int:
    """Where the raw content from ``at`` on ends."""
    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
    if tag == "select" and (end is None or re.compile(r"<select\b", re.I).search(html, at, end.start())):
        end = _NO_OPTION.search(html, at)
        return end.start() if end else len(html)
    return end.end() if end else len(html)


def parse(html: str) -> Node:
    """The tree below a root without a tag. Open ends, stray ends and cut-off tags are put up with."""
    root = now = Node("", frozenset(), None)
    at, open_tags = 0, {}
    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html):
                now.parts.append(html[at:])
            return root
        if m.start() > at:
            now.parts.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                while now.tag != tag:
                    open_tags[now.tag] -= 1
                    now = now.parent
                open_tags[tag] -= 1
                now = now.parent
            elif tag == "p":
                now.parts.append(Node("p", frozenset(), now))
            continue
        foreign = any(open_tags.get(f) for f in FOREIGN)
        closed = CLOSES.get(tag) or ({"p"} if tag not in INLINE and tag not in VOID and tag not in RAW and (not foreign or tag in LEAVES) else None)
        if closed:
            top = now.mark
            while top is not None and top.tag not in closed and top.tag not in BOUNDS:
                top = top.parent.mark
            if top is not None and top.tag in closed:
                while now is not top:
                    open_tags[now.tag] -= 1
                    now = now.parent
                open_tags[now.tag] -= 1
                now = now.parent
        node = Node(tag, _tokens(m[3]) if m[3] else frozenset(), now)
        now.parts.append(node)
        if tag in VOID or m[3].endswith("/") and (foreign or tag in FOREIGN):
            continue
        if tag in RAW:
            at = _raw_end(tag, html, at)
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        now = node


def decoded(text: str) -> str:
    return references.unescape(text) if "&" in text else text


def elements(root: Node) -> list[Node]:
    """All elements in page order, numbered; parents come first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """Text of the kept elements: references decoded, white space in a block made one space, blocks joined by one space."""
    out: list[str] = []
    todo: list = [nodes[0]] if nodes else []
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        if part.tag in RAW:
            continue
        block = part.tag not in INLINE
        own = keep[part.number]
        if block:
            out.append(" ")
            todo.append(" ")
        todo.extend(decoded(p) if isinstance(p, str) else p for p in reversed(part.parts) if own or isinstance(p, Node))
    return _SPACE.sub(" ", "".join(out)).strip()


FEATURES = ["depth", "position", "siblings", "like_siblings", "log_chars", "page_share", "link_share", "tag_density", "word_length", "stops", "paragraphs", "items",
            "own_share", "chars_a_block", "before_chars", "after_chars", "is_paragraph", "is_heading", "is_list", "is_link", "is_table", "is_container", "bad_tag",
            "above_bad_tag", "good_tag", "above_good_tag", "good_tokens", "bad_tokens", "above_good_tokens", "above_bad_tokens", "hidden", "above_hidden"]
#: What an element's names tell. Left out of every second training page, so that shape must tell as much.
NAMED = [FEATURES.index(f) for f in ("bad_tag", "above_bad_tag", "good_tag", "above_good_tag", "good_tokens", "bad_tokens", "above_good_tokens", "above_bad_tokens")]
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def measure(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters of own text, number of the parent) of each element."""
    n = len(nodes)
    own, chars, links, tags, words, stops, paragraphs, items, blocks = (np.zeros(n) for _ in range(9))
    parent = np.array([-1 if x.parent is None else x.parent.number for x in nodes])
    x = np.zeros((n, len(FEATURES)))
    at = {f: k for k, f in enumerate(FEATURES)}
    for i, node in enumerate(nodes):
        text = [p for p in node.parts if isinstance(p, str) and not p.isspace()]
        own[i] = sum(map(len, text))
        words[i] = sum(p.count(" ") + 1 for p in text)
        stops[i] = sum(p.count(".") + p.count("!") + p.count("?") + p.count("。") for p in text)
    chars[:], blocks[:] = own, own > 0
    links[:] = [own[i] if nodes[i].tag == "a" else 0 for i in range(n)]
    paragraphs[:] = [node.tag == "p" for node in nodes]
    items[:] = [node.tag == "li" for node in nodes]
    tags[:] = 1
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = parent[i]
        chars[up] += chars[i]
        links[up] += chars[i] if nodes[i].tag == "a" else links[i]
        for a in (tags, words, stops, paragraphs, items, blocks):
            a[up] += a[i]
    whole = max(chars[0], 1)
    many = np.maximum(chars, 1)
    x[:, at["depth"]] = [node.depth for node in nodes]
    x[:, at["log_chars"]], x[:, at["page_share"]], x[:, at["link_share"]] = np.log1p(chars), chars / whole, links / many
    x[:, at["tag_density"]], x[:, at["word_length"]], x[:, at["stops"]] = tags / many, chars / np.maximum(words, 1), stops / np.maximum(words, 1)
    x[:, at["paragraphs"]], x[:, at["items"]], x[:, at["own_share"]] = np.log1p(paragraphs), items / np.maximum(tags, 1), own / many
    x[:, at["chars_a_block"]] = np.log1p(chars / np.maximum(blocks, 1))
    for i, node in enumerate(nodes):
        children = [p for p in node.parts if isinstance(p, Node)]
        if children:
            kinds: dict[str, int] = {}
            for c in children:
                kinds[c.tag] = kinds.get(c.tag, 0) + 1
            for k, c in enumerate(children):
                row = x[c.number]
                row[at["position"]], row[at["siblings"]], row[at["like_siblings"]] = k / len(children), np.log1p(len(children)), kinds[c.tag] / len(children)
                row[at["before_chars"]] = np.log1p(chars[children[k - 1].number]) if k else 0
                row[at["after_chars"]] = np.log1p(chars[children[k + 1].number]) if k + 1 < len(children) else 0
        row, up = x[i], x[parent[i]] if i else np.zeros(len(FEATURES))
        tag = node.tag
        row[at["is_paragraph"]], row[at["is_heading"]], row[at["is_link"]] = tag == "p", tag in _HEADING, tag == "a"
        row[at["is_list"]], row[at["is_table"]] = tag in ("ul", "ol", "li", "dl"), tag in ("table", "tr", "td", "th")
        row[at["is_container"]] = tag in ("div", "section", "body", "html", "")
        row[at["bad_tag"]], row[at["good_tag"]] = tag in BAD_TAGS, tag in ("article", "main")
        row[at["good_tokens"]], row[at["bad_tokens"]], row[at["hidden"]] = len(node.tokens & GOOD), len(node.tokens & BAD), "#hidden" in node.tokens
        for f in ("bad_tag", "good_tag", "good_tokens", "bad_tokens", "hidden"):
            row[at[f"above_{f}"]] = max(up[at[f]], up[at[f"above_{f}"]])
    return x, own, parent
