"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at every tag that starts or ends a block. A block has its words, its link density (share of
words inside links), those of the blocks before and after it, whether it is a heading, and where it stands: inside an article, or inside an
element for something else (menus, sidebars, footers, adverts, forms, comments, by tag, role, class or id). A decision tree, grown on the
small labelled table below, decides which blocks are main text. Scripts, styles, controls and the like have no text.

End tags that HTML lets pages leave out are implied: a paragraph ends before a block, items, cells, rows, options and headings before their like, the head before
what belongs to the body. Else what is never closed, closed twice or nested wrongly is taken as it comes: an end tag closes what is open down to its own start, or nothing.

Nulls: a null page is empty and has an empty text. Very long pages are read in one pass; equal pages give equal texts; an empty table gives an
empty result. Other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Set
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from headrisk.llm.common import bounded_batches

# Element and attribute names.
RAW = "script style title textarea iframe".split()
#: Elements without text of their own that hold other elements.
SILENT = frozenset("noscript template select option svg math object canvas audio video button".split())
CONTROLS = frozenset("select option button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
                    "time tt u var wbr").split())
ASIDE_TAGS = frozenset("nav aside footer form menu dialog fieldset head".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
ENDS_P = HEADINGS | frozenset(("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre "
                               "search section summary table ul").split())
#: An open paragraph is not looked for beyond these.
AROUND_P = SILENT | frozenset("caption html marquee table td th".split())
_IN_ITEM = INLINE | CONTROLS | {"address", "div", "p"}
_ROWS = frozenset("thead tbody tfoot".split())
#: Start tags to what they end: the open elements, those that may lie between (None: any), and those that may not.
ENDS = {"li": ({"li"}, _IN_ITEM, ()), **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, _IN_ITEM, ())), "option": ({"option"}, INLINE, ()), "optgroup": ({"option", "optgroup"}, INLINE, ()),
        "button": ({"button"}, None, AROUND_P - {"button"}), "a": ({"a"}, INLINE, ()), **dict.fromkeys(HEADINGS, (HEADINGS, INLINE, ())),
        **dict.fromkeys(("td", "th"), ({"td", "th"}, None, _ROWS | {"tr", "table", "template"})), "tr": ({"tr"}, None, _ROWS | {"table", "template"}),
        **dict.fromkeys(_ROWS, (_ROWS | {"caption", "colgroup"}, None, {"table", "template"})), **dict.fromkeys(ARTICLE_TAGS, (CONTROLS, None, SILENT - CONTROLS))}
ASIDE_WORDS = frozenset(("ad ads adv advert advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist reply replies disqus cookie cookies consent gdpr "
                         "copyright disclaimer footer header masthead topbar menu menubar nav navbar navigation navigator newsletter notice notices notification alert popup modal overlay "
                         "pager pagination promo promotion related recommended share sharing sidebar sidebox social sponsor sponsored subscribe subscription signup login widget widgets "
                         "toolbar tags tagcloud skip complementary contentinfo search").split())
ARTICLE_WORDS = frozenset("article articlebody entry post story main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    article: bool
    aside: bool


def _where(tag: str, attrs: str, in_article: int) -> tuple[bool, bool]:
    """Whether an element is (part of) an article, and whether it is for something beside one."""
    names = {w for m in _NAMES.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())} if attrs else set()
    aside = tag in ASIDE_TAGS or not names.isdisjoint(ASIDE_WORDS) and tag not in ("html", "body") or tag == "header" and not in_article
    return tag in ARTICLE_TAGS or not aside and tag not in ("html", "body") and not names.isdisjoint(ARTICLE_WORDS), aside


def blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order."""
    out, parts, linked = [], [], []
    stack: list[tuple[str, int, int, int, int]] = []  # tag; article, aside, heading, link: 1 where it is one
    open_tags: Counter = Counter()
    article = aside = heading = link = silent = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(text.split()), len(html.unescape("".join(linked)).split()), heading > 0, article > 0, aside > 0))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if stack and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if silent:
            return
        parts.append(text)
        if link:
            linked.append(text)

    def close(depth: int) -> None:
        nonlocal article, aside, heading, link, silent
        while len(stack) > depth:
            if not silent and parts and stack[-1][0] not in INLINE:
                flush()
            name, a, b, c, d = stack.pop()
            open_tags[name] -= 1
            article, aside, heading, link, silent = article - a, aside - b, heading - c, link - d, silent - (name in SILENT)

    def imply(ended: Set, between: Set | None, beyond: Collection) -> None:
        """Closes the innermost of the ended elements, unless something lies between that keeps it open."""
        if any(map(open_tags.get, ended)):
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name in ended:
                    return close(k)
                if name in beyond or between is not None and name not in between:
                    return None
        return None

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag not in SILENT and not silent:
            flush()
        if m["end"]:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if not silent and open_tags["head"] and tag not in IN_HEAD:
            imply({"head"}, None, ())
        if tag in ENDS:
            imply(*ENDS[tag])
            if tag == "optgroup" or tag in ARTICLE_TAGS:  # an option and its group, an option and its list
                imply(*ENDS[tag])
        if tag in ENDS_P:
            imply({"p"}, None, AROUND_P)
        if tag not in VOID and not m["attrs"].endswith("/"):
            a, b = _where(tag, m["attrs"], article)
            c, d = tag in HEADINGS, tag == "a"
            stack.append((tag, a, b, c, d))
            open_tags[tag] += 1
            article, aside, heading, link, silent = article + a, aside + b, heading + c, link + d, silent + (tag in SILENT)
    if at < len(page):
        add(page[at:])
    flush()
    return out


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "aside"]


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: its words, link density, place, and the words and link density of its neighbours."""
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found]) if found else words
    shifted = lambda x, k: np.r_[np.zeros(1), x[:-1]] if k < 0 else np.r_[x[1:], np.zeros(1)]
    return np.column_stack([words, links, shifted(words, -1), shifted(links, -1), shifted(words, 1), shifted(links, 1), [b.heading for b in found], [b.article for b in found],
                            [b.aside for b in found]]) if found else np.zeros((0, len(FEATURES)))


#: The labelled table, as small pages: each block has its words, how many of them are links, where it stands (A article, B beside, H heading, - nowhere said) and its label.
LABELLED = [
    [(1, 1, "B", 0), (1, 1, "B", 0), (2, 2, "B", 0), (9, 0, "B", 0), (7, 0, "AH", 1), (60, 0, "A", 1), (1, 0, "A", 1), (130, 2, "A", 1), (25, 0, "A", 1), (9, 1, "B", 0)],
    [(12, 0, "B", 0), (5, 0, "AH", 1), (3, 0, "A", 1), (40, 5, "A", 1), (2, 0, "A", 1), (8, 8, "A", 1), (80, 0, "A", 1), (30, 0, "AB", 0), (14, 4, "AB", 0), (6, 0, "B", 0)],
    [(4, 4, "B", 0), (70, 0, "B", 0), (90, 3, "B", 0), (6, 0, "H", 1), (75, 1, "-", 1), (64, 0, "-", 1), (33, 0, "-", 1), (55, 0, "B", 0), (48, 0, "B", 0), (10, 2, "-", 0)],
    [(2, 2, "-", 0), (3, 3, "-", 0), (2, 2, "-", 0), (8, 0, "H", 1), (45, 0, "-", 1), (120, 6, "-", 1), (18, 0, "-", 1), (52, 0, "-", 1), (3, 3, "-", 0), (4, 2, "-", 0), (5, 0, "-", 0)],
    [(3, 1, "-", 0), (2, 2, "-", 0), (6, 6, "-", 0), (35, 0, "-", 1), (44, 2, "-", 1), (12, 12, "-", 0), (9, 9, "-", 0), (7, 1, "-", 0), (4, 0, "-", 0)],
    [(1, 1, "B", 0), (10, 0, "AH", 1), (220, 0, "A", 1), (15, 0, "A", 1), (4, 4, "A", 1), (36, 0, "AB", 0), (41, 1, "AB", 0), (2, 1, "B", 0), (16, 0, "B", 0), (3, 0, "B", 0)],
    [(1, 1, "B", 0), (1, 1, "B", 0), (3, 0, "AH", 1), (4, 0, "A", 1), (2, 0, "A", 1)],
    [(2, 2, "B", 0), (9, 0, "B", 0), (2, 0, "AH", 1), (1, 1, "A", 1), (2, 2, "A", 1), (50, 0, "A", 1), (3, 1, "A", 1)],
    [(6, 0, "AH", 1), (6, 2, "A", 1), (3, 3, "A", 1), (12, 12, "AB", 0), (5, 0, "A", 1)],
    [(10, 0, "A", 1)],
    [(3, 3, "-", 0), (5, 1, "-", 0), (8, 4, "A", 1), (5, 5, "A", 1), (1, 0, "A", 1), (4, 4, "-", 0)],
    [(5, 5, "-", 0), (4, 0, "H", 0), (3, 3, "-", 0), (3, 3, "-", 0), (28, 0, "-", 1), (31, 1, "-", 1), (4, 0, "H", 1), (57, 0, "-", 1), (2, 0, "-", 0), (6, 6, "-", 0)],
]
MAX_DEPTH = 6


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    pages = [[Block("", w, n, "H" in p, "A" in p, "B" in p) for w, n, p, _ in page] for page in LABELLED]
    return np.concatenate([features(p) for p in pages]), np.array([b[3] for page in LABELLED for b in page])


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
    """A tree as nested (feature, limit, tree up to the limit, tree above it), with a label at the leaves; splits lower the Gini impurity most."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() > len(y))
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            cost = sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in (y[low], y[~low]))
            if cost < best[0] - 1e-9:
                best = (cost, f, limit)
    if best[1] is None:
        return int(2 * y.sum() > len(y))
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(1)
def tree():
    """The tree of the labelled table; grown in milliseconds, the same in every task."""
    return grow(*labelled_table())


def classify(x: np.ndarray, node=None) -> np.ndarray:
    node = tree() if node is None else node
    if isinstance(node, int):
        return np.full(len(x), node == 1)
    f, limit, low, high = node
    return np.where(x[:, f] <= limit, classify(x, low), classify(x, high))


def main_text(page: str | None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, good in zip(found, classify(features(found))) if good)


@F.arrow_udf(T.StringType())
def main_text_of(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """The pages with `text` in place of `html`."""
    bounded_batches(pages.sparkSession)
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text")]
    return pages.select(*rest, main_text_of("html").alias("text"))
