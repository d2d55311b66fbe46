"""Main text of web pages: boosted trees over the elements of a page, and one consistent choice for the whole tree.

Training. Elements are labelled on two bounded samples. Real pages (``FIT_PAGES``, chosen by a hash of the id) that have exactly
one ``article`` or ``main`` element: it and what lies in it are main text, but for what names itself a menu, advert,
form and the like. And ``LAYOUTS`` pages whose layout is drawn from a seed and so is known: with and without telling names, with
sidebars, notices, adverts within the text, forms and reader comments, filled with words of the real pages. Every page is used once
with and once without the features that names give.

Decoding. An element's log odds say whether its text is main text. Over the tree a dynamic programme finds the best of: drop
an element with all below it, keep it with all below it, or open it and choose for each child (which costs ``OPEN``, as
pages seldom mix both). What is dropped has no kept descendant, what is kept no dropped one.

A null or empty page, or one without main text, gives the empty text. Repeated rows give a row each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import boosting, dom
from wardline.llm import words as W
from wardline.llm.common import prepare, rows_of

FIT_PAGES = 150
LAYOUTS = 250
MOST_CHARS = 200_000  # of a page that is trained on
OPEN = 1.0
BLOCK_BYTES = 2 << 20

TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
TEXT_DDL = "page_id bigint, url string, text string, n_chars bigint"

_NAMES_IT = dom.BAD_TAGS - {"figcaption"}


def taught(nodes: list[dom.Node]) -> np.ndarray | None:
    """Labels of a page whose one ``article`` or ``main`` element tells; None: the page does not say."""
    tops = [n for n in nodes if n.tag in ("article", "main") and not _within(n, ("article", "main"))]
    if len(tops) != 1:
        return None
    good = np.zeros(len(nodes), bool)
    for node in nodes[1:]:
        named = node.tag in _NAMES_IT or bool(node.tokens & dom.BAD) or "#hidden" in node.tokens
        good[node.number] = node is tops[0] or (good[node.parent.number] and not named)
    return good


def _within(node: dom.Node, tags: tuple) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in tags:
            return True
        up = up.parent
    return False


_MARK = "data-main"


def layouts(words: list[str], count: int = LAYOUTS, seed: int = 17) -> list[str]:
    """Pages of drawn layouts; elements of main text carry the attribute ``data-main``."""
    draw = np.random.default_rng(seed)
    words = words or ["lorem", "ipsum", "dolor", "sit", "amet"]

    def some(low: int, high: int) -> str:
        return " ".join(words[k] for k in draw.integers(0, len(words), int(draw.integers(low, high))))

    def sentences(low: int, high: int) -> str:
        return " ".join(some(4, 18).capitalize() + "." for _ in range(int(draw.integers(low, high))))

    def either(p: float) -> bool:
        return bool(draw.random() < p)

    def box(names: str, inner: str, tags: str = "div") -> str:
        """A part under one of its names; without telling names a plain container."""
        tag = str(draw.choice(tags.split()))
        return f'<{tag} class="{draw.choice(names.split())}">{inner}</{tag}>' if either(0.7) else f"<{tag if either(0.5) else 'div'}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{some(1, 4)}</a></li>' for k in range(int(draw.integers(low, high)))) + "</ul>"

    def paragraph() -> str:
        return f"<p {_MARK}>{sentences(1, 7)}" + (f' <a {_MARK} href="/x">{some(1, 4)}</a> {sentences(1, 3)}' if either(0.25) else "") + (f" <b {_MARK}>{some(1, 5)}</b>" if either(0.2) else "") + "</p>"

    pages = []
    for _ in range(count):
        parts = [f"<h1 {_MARK}>{some(2, 9)}</h1>"] if either(0.8) else []
        for _ in range(int(draw.integers(1, 14))):
            kind = draw.random()
            if kind < 0.75:
                parts.append(paragraph())
            elif kind < 0.82:
                parts.append(f"<h2 {_MARK}>{some(2, 7)}</h2>")
            elif kind < 0.87:
                parts.append(f"<ul {_MARK}>" + "".join(f"<li {_MARK}>{sentences(1, 3)}</li>" for _ in range(int(draw.integers(2, 6)))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote {_MARK}><p {_MARK}>{sentences(1, 4)}</p></blockquote>")
            elif kind < 0.95:
                parts.append(box("ad advert sponsored promo", some(3, 12), "div aside"))
            else:
                parts.append(box("related share newsletter social", links(2, 5), "div aside"))
        comments = "".join(box("comment reply", f"<span>{some(1, 3)}</span><p>{sentences(1, 4)}</p>", "div li") for _ in range(int(draw.integers(1, 6)))) if either(0.4) else ""
        comments = box("comments disqus replies", f"<h3>{some(1, 3)}</h3>{comments}", "section div") if comments else ""
        inside = either(0.3)
        tag, name = ("article", "") if either(0.4) else ("div", f' class="{draw.choice("content post entry main story x7 c".split())}"' if either(0.6) else "")
        article = f"<{tag}{name} {_MARK}>" + "".join(parts) + (comments if inside else "") + f"</{tag}>"
        page = [box("nav menu navbar", links(3, 10), "nav div")] if either(0.9) else []
        if either(0.5):
            page.insert(0, box("header masthead banner", f"<h2>{some(1, 4)}</h2><p>{some(2, 8)}</p>", "header div"))
        if either(0.3):
            page.append(box("cookie notice consent", f"<p>{sentences(1, 3)}</p><button>{some(1, 2)}</button>", "div section"))
        if either(0.5):
            page.append(box("ad ads banner sponsor", sentences(1, 3) if either(0.5) else some(3, 12), "div aside"))
        page.append(article)
        if not inside:
            page.append(comments)
        if either(0.5):
            page.insert(int(draw.integers(0, len(page) + 1)), box("sidebar related widget", f"<h3>{some(1, 3)}</h3>" + links(3, 9) + f"<p>{some(4, 16)}</p>", "aside div"))
        if either(0.3):
            page.append(box("login search subscribe", f"<form><label>{some(1, 3)}</label><input><button>{some(1, 2)}</button></form>", "form div"))
        if either(0.9):
            page.append(box("footer copyright legal", f"&copy; {some(2, 8)} {sentences(0, 2)}", "footer div"))
        pages.append(f"<html><head><title>{some(2, 8)}</title></head><body>{''.join(page)}</body></html>")
    return pages


_MARKED = re.compile(rf"<(\w+)([^>]*?) {_MARK}([^>]*)>")


def _known(page: str) -> tuple[list[dom.Node], np.ndarray]:
    """Nodes and labels of a drawn page: the mark becomes a token, which no feature looks at."""
    nodes = dom.elements(dom.parse(_MARKED.sub(r'<\1\2 role="zmain"\3>', page)))
    return nodes, np.array(["zmain" in n.tokens for n in nodes])


def train(pages: list[str]) -> boosting.BoostedTrees:
    """Boosted trees from real pages that tell and from drawn ones."""
    examples, words = [], []
    for page in pages:
        nodes = dom.elements(dom.parse(page[:MOST_CHARS]))
        labels = taught(nodes)
        words += dom.text_of(nodes, np.ones(len(nodes), bool)).split()[:200]
        if labels is not None:
            examples.append((nodes, labels))
    examples += [_known(page) for page in layouts(words[:20_000])]
    xs, ys, ws = [], [], []
    for nodes, labels in examples:
        x, own, _ = dom.measure(nodes)
        blank = x.copy()
        blank[:, dom.NAMED] = 0
        # Containers count as main text by what they mostly hold; elements without text teach nothing.
        used = (own > 0) | labels
        xs += [x[used], blank[used]]
        ys += [labels[used]] * 2
        ws += [np.full(int(used.sum()), 1 / max(1, int(used.sum()))), np.full(int(used.sum()), 0.5 / max(1, int(used.sum())))]
    weight = np.concatenate(ws)
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), weight * len(weight) / weight.sum())


def choose(logits: np.ndarray, own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Kept elements: the best consistent choice over the tree. Elements weigh by their text."""
    n = len(logits)
    weight = np.where(own > 0, np.log2(2 + own), 0.5)
    keep, drop = -np.logaddexp(0, -logits) * weight, -np.logaddexp(0, logits) * weight
    all_kept, all_dropped = keep.copy(), drop.copy()
    for i in range(n - 1, 0, -1):
        all_kept[parent[i]] += all_kept[i]
        all_dropped[parent[i]] += all_dropped[i]
    # Opened: the element's own text, if any, goes by its own odds, and each child by its best choice.
    opened = np.where(own > 0, np.maximum(keep, drop), 0.0) - OPEN
    best = np.maximum(all_kept, all_dropped)
    for i in range(n - 1, 0, -1):
        best[i] = max(all_kept[i], all_dropped[i], opened[i])
        opened[parent[i]] += best[i]
    kept = np.zeros(n, bool)
    state = np.zeros(n, np.int8)  # 1 kept whole, -1 dropped whole, 0 opened
    for i in range(n):
        above = state[parent[i]] if i else 0
        if above:
            state[i] = above
        elif opened[i] > all_kept[i] and opened[i] > all_dropped[i]:
            state[i] = 0
        else:
            state[i] = 1 if all_kept[i] >= all_dropped[i] else -1
        kept[i] = state[i] == 1 or (state[i] == 0 and keep[i] > drop[i] and own[i] > 0)
    return kept


def _extract(model: boosting.BoostedTrees):
    def work(batches):
        for table in W.blocks(batches, "html", BLOCK_BYTES):
            measured = []
            for page in table.column("html").to_pylist():
                nodes = dom.elements(dom.parse(page or ""))
                measured.append((nodes, *dom.measure(nodes)))
            logits = model.logits(np.concatenate([m[1] for m in measured]))
            texts, low = [], 0
            for nodes, _, own, parent in measured:
                texts.append(dom.text_of(nodes, choose(logits[low:low + len(nodes)], own, parent)))
                low += len(nodes)
            ids, urls = (table.column(c).combine_chunks() for c in ("page_id", "url"))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=TEXT)

    return work


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; at most ``fit_pages`` pages are trained on."""
    prepare(pages.sparkSession)
    own = rows_of(pages, page_id=id, url=url, html=html).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    sample = own.where("html IS NOT NULL").select(F.xxhash64("page_id", "url").alias("h"), F.substring("html", 1, MOST_CHARS).alias("html")).orderBy("h").limit(fit_pages)
    model = train([r for r in sample.select("html").toArrow().column("html").to_pylist()])
    return own.mapInArrow(_extract(model), TEXT_DDL)
