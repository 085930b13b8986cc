"""Main text of web pages by a tree-structured graphical model.

Each block element and text run of a page is a node that is content or not.
Scores come from the node's own features and from the labels of parent and
child together; messages passed up and then down the tree give every node's
marginal. The weights maximise the likelihood of labelled pages.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.page_tree import Node, read

#: Words in class, id and role that speak against and for content.
AGAINST = frozenset(
    "ad ads adslot advert advertisement advertising alert author banner bio breadcrumb breadcrumbs comment commentlist comments "
    "consent contentinfo cookie cookies copyright dialog discussion disqus footer gdpr header login masthead menu message modal "
    "nav navbar navigation newsletter notice notification pager pagination popup privacy promo promoted promotion reader recommended "
    "related replies reply respond responses search share sharing sidebar signup site skip social sponsor sponsored sponsors "
    "subscribe subscription tags toolbar topbar widget".split()
)
IN_FAVOUR = frozenset("article body content entry main post story text".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_KINDS = (
    ("nav", "menu"),
    ("header",),
    ("footer",),
    ("aside", "dialog"),
    ("form", "button", "select", "option", "fieldset", "label", "legend", "textarea"),
    ("article", "main"),
    ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("p", "blockquote", "pre"),
    ("ul", "ol", "dl", "li", "dt", "dd"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    ("head", "title"),
    ("figure", "figcaption"),
    ("",),
)
_KIND = {tag: i for i, tags in enumerate(_KINDS) for tag in tags}
_OTHER = len(_KINDS)
_N_KINDS = _OTHER + 1
#: After the kinds: bias, names against and for, link share, length of own or inner text, ends of sentences, small print.
N_FEATURES = _N_KINDS + 11
#: Parent and child labels together, for children that are elements and for text runs.
N_EDGES = 8


def node_features(nodes: list[Node]) -> list[tuple[int, ...]]:
    """The features that are on, for each node."""
    size, linked = [len(n.text) for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        linked[nodes[i].parent] += linked[i]
    found = []
    for n, length, inside in zip(nodes, size, linked, strict=True):
        on = [_KIND.get(n.tag, _OTHER), _N_KINDS]
        if n.names:
            words = {w.lower() for w in _WORD.findall(n.names)}
            if words & AGAINST:
                on.append(_N_KINDS + 1)
            elif words & IN_FAVOUR:
                on.append(_N_KINDS + 2)
        if length:
            share = inside / length
            if share > 0.5:
                on.append(_N_KINDS + 3)
            elif share > 0.15:
                on.append(_N_KINDS + 4)
        on.append(_N_KINDS + (5 if length == 0 else 6 if length < 40 else 7 if length < 160 else 8))
        if n.text:
            if n.text[-1] in ".!?…\"”»":
                on.append(_N_KINDS + 9)
            if "©" in n.text:
                on.append(_N_KINDS + 10)
        found.append(tuple(on))
    return found


@dataclass(frozen=True)
class PageModel:
    weights: tuple[float, ...]
    edges: tuple[float, ...]  # [is text run][parent][child]


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(
    nodes: list[Node], on: list[tuple[int, ...]], model: PageModel, pairs: list[list[float]] | None = None
) -> list[float]:
    """P(content) of each node by sum-product: messages up, then down.

    Messages are differences of logs, content minus not. With `pairs` given, the
    joint probabilities of (parent, child) are added to it, as in model.edges.
    """
    w, e = model.weights, model.edges
    n = len(nodes)
    belief = [sum(w[f] for f in own) for own in on]  # own score, then with the children's messages
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        k = 0 if nodes[i].tag else 4
        b = belief[i]
        up[i] = _sum(e[k + 2], e[k + 3] + b) - _sum(e[k], e[k + 1] + b)
        belief[nodes[i].parent] += up[i]
    own = belief[:]  # without what comes from above
    for i in range(1, n):
        k = 0 if nodes[i].tag else 4
        above = belief[nodes[i].parent] - up[i]
        if pairs is not None:
            joint = [e[k], e[k + 1] + own[i], e[k + 2] + above, e[k + 3] + above + own[i]]
            top = max(joint)
            joint = [math.exp(j - top) for j in joint]
            total = sum(joint)
            for j in range(4):
                pairs[k // 4][j] += joint[j] / total
        belief[i] += _sum(e[k + 1], e[k + 3] + above) - _sum(e[k], e[k + 2] + above)
    return [1 / (1 + math.exp(-b)) if b > -700 else 0.0 for b in belief]


def fit(pages: list[tuple[list[Node], list[bool]]], steps: int = 60, rate: float = 0.15, penalty: float = 0.002) -> PageModel:
    """Maximum likelihood over labelled pages (nodes, is content), by Adam on exact marginals."""
    seen = [(nodes, node_features(nodes), labels) for nodes, labels in pages]
    theta = np.zeros(N_FEATURES + N_EDGES)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros_like(theta)
    for nodes, on, labels in seen:
        for i, own in enumerate(on):
            if labels[i]:
                gold[list(own)] += 1
            if i:
                gold[N_FEATURES + (0 if nodes[i].tag else 4) + 2 * labels[nodes[i].parent] + labels[i]] += 1
    for step in range(1, steps + 1):
        model = PageModel(tuple(theta[:N_FEATURES].tolist()), tuple(theta[N_FEATURES:].tolist()))
        expected = np.zeros_like(theta)
        pairs = [[0.0] * 4, [0.0] * 4]
        for nodes, on, _ in seen:
            for own, p in zip(on, marginals(nodes, on, model, pairs), strict=True):
                for f in own:
                    expected[f] += p
        expected[N_FEATURES:] = pairs[0] + pairs[1]
        gradient = (gold - expected) / len(seen) - penalty * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return PageModel(tuple(theta[:N_FEATURES].tolist()), tuple(theta[N_FEATURES:].tolist()))


def label(nodes: list[Node], is_content: Iterator[bool] | list[bool]) -> list[bool]:
    """Labels of all nodes from those of the text runs, in page order: an element is content if it holds some."""
    runs = iter(is_content)
    labels = [bool(n.text) and next(runs) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if labels[i]:
            labels[nodes[i].parent] = True
    return labels


#: Content runs of the training pages hold this mark, taken out before features are made.
_MARK = "\x01"


def training_page(pick: random.Random) -> str:
    """A made-up page whose content runs begin with the mark: the labelled pages are drawn from this grammar."""
    words = "alder birch cedar dune ember fjord grove heath inlet jetty knoll ledge marsh notch orchard pond quarry reef".split()

    def phrase(least: int, most: int) -> str:
        return " ".join(pick.choices(words, k=pick.randint(least, most))).capitalize()

    def prose(mark: str) -> str:
        return mark + ". ".join(phrase(2, 16) for _ in range(pick.choice((1, 1, 2, 3, 6)))) + "."

    def links(n: int) -> str:
        items = [f'<a href="/{w}">{w}</a>' for w in pick.choices(words, k=n)]
        kind = pick.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return pick.choice((" | ", " ")).join(items)

    def box(tag: str, name: str, inside: str) -> str:
        attribute = pick.choice((f' class="{name}"', f' id="{name}"', f' class="x {name}-box"'))
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def paragraphs(n: int) -> str:
        out = []
        for _ in range(n):
            text = prose(_MARK) if pick.random() < 0.8 else _MARK + phrase(1, 6) + pick.choice((".", ""))
            kind = pick.random()
            if kind < 0.78:
                out.append(f"<p>{text}</p>")
            elif kind < 0.84:
                out.append(f"<h2>{_MARK}{phrase(1, 6)}</h2><p>{text}</p>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{_MARK}{phrase(2, 9)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                out.append(f'<p>{text} <a href="#">{phrase(1, 2)}</a> {phrase(3, 9)}.</p>')
            elif kind < 0.97:
                out.append(f"<blockquote>{text}</blockquote>")
            else:
                out.append(f"<table><tr><td>{_MARK}{phrase(1, 3)}</td><td>{_MARK}{phrase(1, 3)}</td></tr></table>")
        return "".join(out)

    def comments() -> str:
        each = "".join(
            pick.choice(("<li>{}</li>", '<div class="comment">{}</div>', "<article>{}</article>")).format(f"<p>{prose('')}</p>")
            for _ in range(pick.randint(1, 4))
        )
        head = pick.choice(("", "<h3>Comments</h3>", "<h2>Replies</h2>"))
        return box(pick.choice(("section", "div", "ol")), pick.choice(("comments", "discussion", "respond", "replies", "reader-comments")), head + each)

    def notice() -> str:
        name = pick.choice(("cookie-notice", "notice", "alert", "consent", "banner", "newsletter", "popup"))
        return box(pick.choice(("div", "section", "p")), name, pick.choice((f"<p>{prose('')}</p>", prose(""))))

    def advert() -> str:
        inside = pick.choice((prose(""), phrase(2, 6), f"<p>{prose('')}</p>"))
        return box("div", pick.choice(("ad", "ads", "advert", "sponsored", "promo")), inside)

    def form() -> str:
        return f"<form><label>{phrase(1, 3)}</label><input><button>{phrase(1, 2)}</button></form>"

    def aside() -> str:
        inside = pick.choice((f"<h3>{phrase(1, 3)}</h3>{links(4)}", f"<p>{prose('')}</p>", links(5)))
        return f"<aside>{inside}</aside>" if pick.random() < 0.5 else box("div", pick.choice(("sidebar", "related", "widget", "social")), inside)

    def extra() -> str:
        return pick.choice((comments, notice, advert, form, aside, lambda: ""))()

    body = []
    if pick.random() < 0.4:
        body.append(notice())
    if pick.random() < 0.5:
        site = pick.choice((f"<h1>{phrase(1, 2)}</h1>", f"<p>{phrase(2, 5)}</p>", f'<a href="/">{phrase(1, 2)}</a>'))
        body.append(f"<header>{site}{'<nav>' + links(4) + '</nav>' if pick.random() < 0.5 else ''}</header>")
    if pick.random() < 0.8:
        menu = links(pick.randint(3, 8))
        body.append(f"<nav>{menu}</nav>" if pick.random() < 0.7 else box("div", pick.choice(("menu", "navbar", "breadcrumbs")), menu))
    if pick.random() < 0.5:
        body.append(advert())
    head = f"<h1>{_MARK}{phrase(2, 9)}</h1>" if pick.random() < 0.85 else ""
    inner = head + paragraphs(pick.choice((1, 2, 4, 8, 14)))
    if pick.random() < 0.25:
        cut = inner.rfind("<p>")
        inner = inner[:cut] + extra() + inner[cut:] if cut > 0 else inner
    if pick.random() < 0.3:
        inner += extra()
    kind = pick.random()
    if kind < 0.6:
        body.append(f"<article>{inner}</article>")
    elif kind < 0.75:
        body.append(f"<main>{inner}</main>")
    elif kind < 0.9:
        body.append(box("div", pick.choice(("content", "post", "article-body", "entry")), inner))
    else:
        body.append(f"<div>{inner}</div>")
    for part in (comments, aside, form, notice):
        if pick.random() < 0.35:
            body.append(part())
    if pick.random() < 0.9:
        small = pick.choice((f"© {phrase(1, 3)}", f"© {phrase(1, 2)} · {prose('')}", links(4), f"<p>{prose('')}</p>"))
        body.append(f"<footer>{small}</footer>" if pick.random() < 0.75 else box("div", "footer", small))
    inside = "".join(body)
    if pick.random() < 0.3:
        inside = f'<div id="page">{inside}</div>'
    return f"<html><head><title>{phrase(2, 8)}</title></head><body>{inside}</body></html>"


def labelled_page(page: str) -> tuple[list[Node], list[bool]]:
    nodes = read(page)
    runs = []
    for n in nodes:
        if n.text:
            runs.append(n.text.startswith(_MARK))
            n.text = n.text.replace(_MARK, "").strip()
    return nodes, label(nodes, runs)


@functools.cache
def trained(pages: int = 220, seed: int = 7) -> PageModel:
    """The model fitted on `pages` labelled pages; the same on every driver."""
    pick = random.Random(seed)
    return fit([labelled_page(training_page(pick)) for _ in range(pages)])


def main_text(page: str, model: PageModel) -> str:
    """The content runs of a page, joined by two line feeds."""
    nodes = read(page)
    found = marginals(nodes, node_features(nodes), model)
    return "\n\n".join(n.text for n, p in zip(nodes, found, strict=True) if n.text and p >= 0.5)


def extract_pages(
    pages: DataFrame, model: PageModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A block is a run of text within a block element; character references are
    decoded, white space becomes one space, script, style and comments are
    skipped. Null and empty html and pages without content give the empty text.
    Malformed markup is read as it stands: open paragraphs, list items and
    cells end where the next begins. Ids may be null or repeat: one row out per
    row in. Other columns are neither read nor returned.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) if page else "" for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    asked = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return asked.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars bigint")
