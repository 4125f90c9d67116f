"""Main text of web pages by a tree-structured graphical model over DOM elements.

Each element is content or not. Its unary potential comes from its tag, class and id words,
amount of text and share of link text; a potential for each kind of child ties it to its
parent. One sum-product pass up the tree and one down give every element's exact marginal, and
text that stands directly in an element is kept when content is likelier. Weights are fitted
by gradients of the likelihood on labelled pages: ``LABELLED`` layouts below, whose elements
carry ``data-label``, and at most ``rows`` pages of the table whose landmarks label them.

Defined results: a null or empty page, or one without content, has the empty text; tags that the
end of a page cuts off are dropped; unclosed elements end with their parent, and what an unclosed
svg, template, title, textarea or iframe holds is judged like any other text; a script or style
without an end is code up to the end of its page, as in HTML; repeated rows give equal rows; no
pages give no rows; other columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import bounded_sample, slices

ROWS = 150
WIDTH = 1024
EPOCHS = 12
LABEL = "data-label"

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose contents hold no tags, and those of them that are code.
RAW = frozenset("script style textarea title iframe".split())
CODE = frozenset("script style".split())
#: Start tags inside these end no element outside of them.
SCOPES = frozenset("svg template".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br html head body".split())
#: A start tag that ends an open element of these names.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",),
            "body": ("head",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
         "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": (), "body": ()}
#: Elements whose contents are no text of the page whatever they hold.
NEVER = RAW | SCOPES | frozenset("head button select option".split())
#: The tag of those that never end: what follows them isn't theirs.
UNCLOSED = "#unclosed"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
                    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(?:/[^>]*>)?|[^<]+", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Page:
    """Elements in page order (parents first) and the text between their tags."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    #: (element or -1 for the border of a block, text)
    texts: list[tuple[int, str]] = field(default_factory=list)


def parsed(source: str | None) -> Page:
    """A tolerant parse in one pass; open elements are counted by tag, so it stays linear."""
    page, source = Page(), source or ""
    stack: list[int] = []
    held: dict[str, int] = {}
    near: list[dict[str, int]] = [{}]  # of held, those inside the innermost scope
    ahead: dict[str, int] = {}

    def following(name: str, at: int) -> int:
        """Where the next tag of this name begins, or -1; what was searched isn't searched again."""
        if name not in ahead or 0 <= ahead[name] < at:
            found = re.compile(rf"<{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            ahead[name] = found.start() if found else -1
        return ahead[name]

    def opened(tag: str, names: str = "", label: str = "") -> int:
        page.tags.append(tag)
        page.parents.append(stack[-1] if stack else -1)
        page.names.append(names)
        page.labels.append(label)
        return len(page.tags) - 1

    def close_to(tag: str) -> None:
        while stack:
            at = stack.pop()
            own = page.tags[at]
            if own in SCOPES:
                near.pop()
            held[own] -= 1
            near[-1][own] -= 1
            if own in BLOCK:
                page.texts.append((-1, ""))
            if own == tag:
                return
            if own in RAW or own in SCOPES:
                page.tags[at] = UNCLOSED

    def push(at: int) -> None:
        stack.append(at)
        own = page.tags[at]
        held[own] = held.get(own, 0) + 1
        near[-1][own] = near[-1].get(own, 0) + 1
        if own in SCOPES:
            near.append({})

    push(opened("#page"))
    at = 0
    while at < len(source):
        token = _TOKEN.match(source, at)
        if token is None:  # a tag with an open quote up to the end
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            piece = token[0]
            if not piece.startswith("<") or piece == "<":
                page.texts.append((stack[-1], piece))
            continue
        if not token[4]:
            break  # cut off inside a tag
        tag = tag.lower()
        if token[1]:
            if held.get(tag):
                close_to(tag)
            continue
        if tag in CLOSES_P and near[-1].get("p"):
            close_to("p")
        for other in SIBLINGS.get(tag, ()):
            if near[-1].get(other):
                inner = next(page.tags[i] for i in reversed(stack)
                             if page.tags[i] == other or page.tags[i] in HOLDS[tag])
                if inner == other:
                    close_to(other)
        empty = tag in VOID or token[3].endswith("/")
        if tag in RAW:  # nothing in it is text of the page
            end = following(f"/{tag}", at)
            # after '/>', an end belongs to it only when no other such element begins before
            if end >= 0 and not (empty and 0 <= following(tag, at) < end):
                at = source.find(">", end)
                at = len(source) if at < 0 else at + 1
                continue
            if tag in CODE and not empty:
                break
        names = label = ""
        if token[3]:
            found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in
                     _ATTRIBUTE.finditer(token[3])}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            label = found.get(LABEL, "")
        if tag in BLOCK:
            page.texts.append((-1, ""))
        own = opened(tag, names.strip(), label)
        if not empty:
            push(own)
    for at in stack:
        if page.tags[at] in RAW or page.tags[at] in SCOPES:
            page.tags[at] = UNCLOSED
    return page


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WIDTH


_NAMES: dict[tuple[str, str], tuple[int, ...]] = {}


def _name_slots(tag: str, names: str) -> tuple[int, ...]:
    """Slots of a tag with its class and id words; kept for repeated ones, up to a bound."""
    key = (tag, names)
    if key not in _NAMES:
        if len(_NAMES) > 20_000:
            _NAMES.clear()
        words = {w.lower() for w in _PART.findall(names)}
        _NAMES[key] = tuple({_slot("bias"), _slot(f"tag {tag}"), *(_slot(f"name {w}") for w in words)})
    return _NAMES[key]


def features(page: Page) -> list[tuple[int, ...]]:
    """Slots of each element's features."""
    n = len(page.tags)
    chars, links = [0] * n, [0] * n
    for at, text in page.texts:
        if at >= 0:
            chars[at] += len(text)
            if page.tags[at] == "a":
                links[at] += len(text)
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        links[page.parents[i]] += chars[i] if page.tags[i] == "a" else links[i]
    found = []
    for i, tag in enumerate(page.tags):
        share = 4 * links[i] // chars[i] if chars[i] else 0
        found.append((*_name_slots(tag, page.names[i]),
                      _slot(f"chars {min(chars[i].bit_length() // 2, 6)}"), _slot(f"links {share}")))
    return found


def _kinds(page: Page) -> list[int]:
    """0 for inline, 1 for block elements, 2 for those that begin a region of their own."""
    regions = ("article main section nav aside header footer form body div".split())
    return [2 if t in regions or n else 1 if t in BLOCK else 0
            for t, n in zip(page.tags, page.names, strict=True)]


@dataclass
class TreeModel:
    weights: np.ndarray  # a slot's log odds of content
    ties: np.ndarray  # kind, parent's state, child's state: log potentials

    def marginals(self, page: Page, pairs: bool = False):
        """Probability of content of each element; with ``pairs`` also of parent and child."""
        weights, potentials = self.weights.tolist(), np.exp(self.ties).tolist()
        slots, kinds, parents, n = features(page), _kinds(page), page.parents, len(page.tags)
        up = [(1.0, 1.0)] * n  # messages to the parent
        b0, b1 = [1.0] * n, [1.0] * n  # own potential times the children's messages
        for i in range(n - 1, -1, -1):
            s = sum(weights[k] for k in slots[i])
            s = math.exp(max(-30.0, min(30.0, s)))
            x, y = b0[i] / (1 + s), b1[i] * s / (1 + s)
            t = x + y
            b0[i], b1[i] = x, y = x / t, y / t
            if i:
                p = potentials[kinds[i]]
                m0, m1 = p[0][0] * x + p[0][1] * y, p[1][0] * x + p[1][1] * y
                t = m0 + m1
                up[i] = (m0 / t, m1 / t)
                j = parents[i]
                x, y = b0[j] * m0 / t, b1[j] * m1 / t
                t = x + y
                b0[j], b1[j] = x / t, y / t
        f0, f1 = b0[:], b1[:]  # with the message from above
        both = []
        for i in range(1, n):
            j = parents[i]
            c0, c1 = f0[j] / up[i][0], f1[j] / up[i][1]
            p = potentials[kinds[i]]
            d0, d1 = p[0][0] * c0 + p[1][0] * c1, p[0][1] * c0 + p[1][1] * c1
            if pairs:
                q = ((c0 * p[0][0] * b0[i], c0 * p[0][1] * b1[i]),
                     (c1 * p[1][0] * b0[i], c1 * p[1][1] * b1[i]))
                t = q[0][0] + q[0][1] + q[1][0] + q[1][1]
                both.append(tuple(v / t for row in q for v in row))
            x, y = b0[i] * d0, b1[i] * d1
            t = x + y
            f0[i], f1[i] = x / t, y / t
        return (f1, both, slots, kinds) if pairs else f1


def main_text(page: Page, content: list[float]) -> str:
    """Texts of content elements: references decoded, white space joined, blocks in order."""
    never = [False] * len(page.tags)
    for i, tag in enumerate(page.tags):
        never[i] = tag in NEVER or (i > 0 and never[page.parents[i]])
    parts = []
    for at, text in page.texts:
        if at < 0:
            parts.append(" ")
        elif content[at] > 0.5 and not never[at]:
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


#: Landmarks that label the pages of a table, and class words that end content inside them.
CONTENT_TAGS = ("article", "main")
OTHER_TAGS = ("nav", "aside", "footer", "header", "form", "menu", "dialog", "button")
OTHER_NAMES = frozenset("ad ads advert advertisement banner breadcrumb comment comments consent "
                        "cookie form menu nav newsletter notice pagination popup promo related "
                        "share sidebar social sponsor sponsored subscribe toolbar widget".split())


def labelled(page: Page) -> list[int] | None:
    """Labels by ``data-label``, or by landmarks; None when a page has neither."""
    found, any_label = [0] * len(page.tags), False
    for i, tag in enumerate(page.tags):
        above = found[page.parents[i]] if i else 0
        words = {w.lower() for w in _PART.findall(page.names[i])}
        if page.labels[i]:
            found[i], any_label = int(page.labels[i] == "1"), True
        elif tag in OTHER_TAGS or tag in NEVER or words & OTHER_NAMES:
            found[i] = 0
        elif tag in CONTENT_TAGS and not any_label:
            found[i], any_label = 1, True
        else:
            found[i] = above
    return found if any_label else None


def fitted(pages: list[tuple[Page, list[int]]], epochs: int = EPOCHS, seed: int = 6) -> TreeModel:
    """Gradient steps (Adam) on the likelihood of whole labelled trees."""
    model = TreeModel(np.zeros(WIDTH), np.tile(np.array([[0.5, -0.5], [-0.5, 0.5]]), (3, 1, 1)))
    rng, step = np.random.default_rng(seed), 0
    moments = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((3, 2, 2)), np.zeros((3, 2, 2))]
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            page, y = pages[k]
            content, both, slots, kinds = model.marginals(page, pairs=True)
            gw, gt = -1e-3 * model.weights, -1e-3 * model.ties
            for own, p, label in zip(slots, content, y, strict=True):
                for s in own:
                    gw[s] += label - p
            for i, q in enumerate(both, 1):
                gt[kinds[i]] -= np.reshape(q, (2, 2))
                gt[kinds[i], y[page.parents[i]], y[i]] += 1
            step += 1
            for at, (g, target) in enumerate(((gw, model.weights), (gt, model.ties))):
                m, v = moments[2 * at], moments[2 * at + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                target += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            np.clip(model.ties, -4, 4, out=model.ties)
    return model


_FILL = ("The council met on Tuesday to discuss the new bridge over the river and its cost. "
         "Engineers said the work could begin in spring if the weather allows it. ")
_P = "".join(f"<p>{_FILL * k}</p>" for k in (1, 3, 2, 1))
_LINKS = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in
                          ("home", "news", "about", "contact", "sport")) + "</ul>"

#: Small labelled layouts; content begins at ``data-label="1"`` and ends inside it at ``"0"``.
LABELLED = [
    f'<html><head><title>A bridge</title></head><body><header class="site-header"><a href="/">Home</a>'
    f'</header><nav>{_LINKS}</nav><main data-label="1"><h1>A bridge</h1>{_P}'
    f'<aside data-label="0" class="related"><a href="/x">More on bridges</a></aside></main>'
    f'<footer>&copy; The Paper</footer></body></html>',
    f'<html><body><div class="menu">{_LINKS}</div><div class="wrap"><div class="post-body content" '
    f'data-label="1"><h2>A bridge</h2>{_P}<div class="ad" data-label="0">Buy now</div>{_P}</div>'
    f'<div class="sidebar">{_LINKS}<p>{_FILL}</p></div></div><div class="footer">Terms</div></body></html>',
    f'<html><body><div id="cookie-notice" class="cookie consent"><p>We use cookies.</p>'
    f'<button>OK</button></div><article data-label="1"><h1>A bridge</h1>{_P}'
    f'<section class="comments" data-label="0"><h3>Comments</h3><div class="comment"><p>{_FILL}</p></div>'
    f'<div class="comment"><p>Well said.</p></div></section></article><aside class="widget">{_LINKS}</aside></body></html>',
    f'<html><body><nav>{_LINKS}</nav><div class="ad">Cheap boats</div><article data-label="1"><h1>A bridge</h1>'
    f'{_P}<blockquote>{_FILL}</blockquote><ul><li>Cost</li><li>Time</li></ul><table><tr><td>1</td><td>2</td></tr>'
    f'</table><p>See <a href="/b">the plan</a> and <b>the cost</b>.</p><form data-label="0"><p>Subscribe</p>'
    f'<input></form></article><footer>Imprint</footer></body></html>',
    f'<html><body><div class="header">{_LINKS}</div><div class="newsletter"><p>{_FILL}</p></div>'
    f'<div class="article-text entry" data-label="1"><p>{_FILL}<br>{_FILL}</p>{_P}'
    f'<div class="share social" data-label="0"><a href="/s">Share</a></div></div>'
    f'<div class="related"><h3>Related</h3>{_LINKS}</div><div class="comments"><p>{_FILL}</p></div></body></html>',
    f'<html><body><nav>{_LINKS}</nav><article data-label="1"><h1>Short</h1><p>One line.</p></article>'
    f'<footer><p>{_FILL}</p></footer></body></html>',
    '<html><body><article data-label="1"><p>Note</p><p>a, <i>b</i><br>c</p></article></body></html>',
    f'<html><body data-label="0"><header><h1>The Paper</h1><p>{_FILL}</p></header><nav>{_LINKS}</nav>'
    f'<aside class="promo banner"><p>{_FILL}</p></aside><form class="search"><p>Find</p></form></body></html>',
]


def trained(pages: DataFrame, rows: int = ROWS) -> TreeModel:
    """A model from the layouts above and at most ``rows`` pages, by a hash of page_id."""
    short = pages.select("page_id", F.col("html").cast("string").alias("html")).filter(
        F.length("html") < 50_000)
    sample = bounded_sample(short, "page_id", "html", rows)
    own = [parsed(r["html"]) for r in sample.collect()]
    known = [parsed(h) for h in LABELLED] * 3 + own
    return fitted([(p, y) for p in known if (y := labelled(p)) is not None])


def extracted(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url and the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "html"):
            texts = []
            for source in batch.column("html").to_pylist():
                page = parsed(source)
                texts.append(main_text(page, model.marginals(page)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                       F.col("html").cast("string"))
    return own.mapInArrow(extract, "page_id long, url string, text string")
