"""Main text of web pages: flat text blocks, classified by a decision tree over a block's and its neighbours' measures.

A page becomes a list of blocks without nesting. A block knows its words, the share of them inside links, whether it
stands in a container that its tag, role or class names as something other than the article, whether it stands in an
article, and whether it is a heading; the tree also sees the words and link density of the blocks before and after.
The tree is grown by Gini impurity on the labelled table below when the module's ``TREE`` is first used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import map_batches

#: Elements whose content is never text of the page.
_SKIP = "script|style|noscript|template|title|svg|math|iframe|object|select|button|textarea|canvas"


def _token(attrs: str) -> re.Pattern:
    """Comments, skipped elements, declarations and tags. Nothing is tried twice, so a match costs what it is long."""
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?P<skip>{_SKIP})(?=[\s/>])[^>]*+(?:(?P<whole>(?<=/)>)|>.*?(?:(?P<close></(?P=skip)\s*+>)|\Z))|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{attrs})>|</?[a-zA-Z][^>]*+>", re.S | re.I
    )


#: A tag ends at the first > outside of quotes. Where there is none to the page's end, quotes say nothing from there on.
_TOKEN, _UNQUOTED = _token("(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+"), _token("[^>]*+")
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and words of class, id and role that name something other than the article (fixed values).
_OTHER_TAGS = frozenset("nav footer aside form menu dialog head".split())
_OTHER_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer banner cookie cookies consent gdpr notice alert ad ads advert adverts advertisement sponsor sponsored promo promotion share sharing social comment comments disqus respond replies related recommended recommendations breadcrumb breadcrumbs subscribe newsletter widget widgets popup modal overlay login signup search pagination pager contentinfo complementary copyright legal disclaimer".split()
)
_HEADERS = frozenset("header masthead topbar".split())
#: Pieces after such a word that don't change what a name stands for, and pieces that say a name is about something else.
_SUFFIXES = frozenset("area bar block body bottom box button buttons col column container content form group icons inner item items left link links list outer panel right row section top wrap wrapper".split())
_MODIFIERS = frozenset("has have is no not with without hide show".split())
#: Elements that hold the article, whatever their names say.
_ROOTS = frozenset("html body main article".split())
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

#: words, link density, words before, link density before, words after, link density after, in another container, in an article, heading; content?
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0 0
1 1.0 1 1.0 2 1.0 1 0 0 0
2 1.0 1 1.0 9 0.0 1 0 0 0
3 1.0 0 0.0 2 1.0 0 0 0 0
2 1.0 3 1.0 2 1.0 0 0 0 0
2 1.0 2 1.0 8 0.0 0 0 0 0
8 0.0 2 1.0 9 0.0 1 0 0 0
12 0.0 1 1.0 7 0.0 1 0 0 0
40 0.0 1 1.0 7 0.0 1 0 0 0
7 0.0 60 0.0 0 0.0 1 0 0 0
11 0.1 80 0.0 0 0.0 1 0 0 0
25 0.2 80 0.0 3 1.0 1 0 0 0
60 0.0 50 0.0 30 0.0 1 1 0 0
35 0.0 60 0.0 12 0.0 1 1 0 0
4 0.0 35 0.0 60 0.0 1 1 1 0
3 1.0 90 0.0 3 1.0 1 1 0 0
9 0.0 8 0.0 70 0.0 0 1 1 1
1 0.0 9 0.0 70 0.0 0 1 1 1
6 0.0 1 1.0 5 0.0 0 1 1 1
70 0.0 9 0.0 45 0.02 0 1 0 1
45 0.02 70 0.0 1 0.0 0 1 0 1
1 0.0 45 0.0 80 0.0 0 1 0 1
2 0.0 80 0.0 33 0.0 0 1 0 1
5 0.0 2 0.0 7 0.0 0 1 0 1
12 0.5 60 0.0 60 0.0 0 1 0 1
8 0.9 60 0.0 50 0.0 0 1 0 1
4 1.0 70 0.0 60 0.0 0 1 0 1
3 1.0 40 0.0 0 0.0 0 1 0 1
33 0.0 2 0.0 6 1.0 0 1 0 1
90 0.1 33 0.0 0 0.0 0 1 0 1
10 0.0 2 1.0 85 0.0 0 0 1 1
7 0.0 60 0.0 95 0.0 0 0 1 1
4 0.0 3 1.0 40 0.0 0 0 1 1
85 0.0 10 0.0 60 0.0 0 0 0 1
60 0.05 85 0.0 30 0.0 0 0 0 1
30 0.0 60 0.05 45 0.0 0 0 0 1
22 0.0 45 0.0 50 0.0 0 0 0 1
16 0.0 50 0.0 70 0.0 0 0 0 1
12 0.0 60 0.0 40 0.0 0 0 0 1
8 0.0 40 0.0 55 0.0 0 0 0 1
3 0.0 50 0.0 60 0.0 0 0 0 1
45 0.0 22 0.0 5 1.0 0 0 0 1
110 0.2 30 0.0 2 0.0 0 0 0 1
28 0.1 12 0.0 2 1.0 0 0 0 1
5 0.0 2 1.0 2 1.0 0 0 0 0
6 0.0 3 1.0 1 1.0 0 0 1 0
3 0.0 4 1.0 3 1.0 0 0 1 0
5 0.0 3 0.0 0 0.0 0 0 0 0
9 0.0 2 1.0 4 0.5 0 0 0 0
8 0.4 5 1.0 0 0.0 0 0 0 0
14 0.7 50 0.0 9 0.8 0 0 0 0
20 0.6 14 0.7 20 0.6 0 0 0 0
9 0.8 20 0.6 3 1.0 0 0 0 0
30 0.9 6 0.0 30 0.9 0 0 0 0
6 0.5 9 0.8 5 0.0 0 0 0 0
2 0.0 5 0.0 2 0.0 0 0 0 0
4 0.0 2 0.0 3 0.0 0 0 0 0
12 0.0 15 0.0 14 0.0 0 0 0 1
18 0.0 12 0.0 20 0.0 0 0 0 1
25 0.0 20 0.0 18 0.0 0 0 0 1
35 0.0 30 0.0 22 0.0 0 0 0 1
40 0.0 25 0.05 25 0.0 0 0 0 1
22 0.3 18 0.0 16 0.0 0 0 0 1
15 0.0 3 1.0 18 0.0 0 0 0 1
12 0.0 5 0.0 16 0.0 0 0 0 1
20 0.0 18 0.0 3 1.0 0 0 0 1
35 0.0 25 0.0 2 1.0 0 0 0 1
13 0.0 16 0.0 4 1.0 0 0 0 1
14 0.0 25 0.0 0 0.0 0 0 0 1
32 0.0 14 0.0 0 0.0 0 0 0 1
20 0.0 0 0.0 0 0.0 0 0 0 1
36 0.0 0 0.0 0 0.0 0 0 0 1
30 0.0 3 1.0 2 1.0 0 0 0 1
45 0.1 3 1.0 3 1.0 0 0 0 1
7 0.0 20 0.0 6 0.0 0 0 0 1
6 0.0 7 0.0 8 0.0 0 0 0 1
8 0.0 6 0.0 15 0.0 0 0 0 1
9 0.0 8 0.0 7 0.0 0 0 0 1
7 0.0 9 0.0 3 1.0 0 0 0 1
6 0.0 3 1.0 15 0.0 0 0 1 1
5 0.0 20 0.0 18 0.0 0 0 1 1
4 0.0 14 0.0 12 0.0 0 0 1 1
3 1.0 3 1.0 60 0.0 0 0 0 0
2 1.0 2 1.0 120 0.0 0 0 0 0
2 1.0 0 0.0 45 0.0 0 0 0 0
8 0.9 6 1.0 45 0.0 0 0 0 0
30 0.9 30 0.9 60 0.0 0 0 0 0
44 0.95 3 1.0 50 0.0 0 0 0 0
50 0.9 60 0.0 45 0.8 0 0 0 0
3 1.0 60 0.0 3 1.0 0 0 0 0
5 0.9 40 0.0 4 1.0 0 0 0 0
4 1.0 15 0.0 0 0.0 0 0 0 0
6 1.0 12 0.0 18 0.0 0 0 0 0
35 0.8 20 0.0 25 0.9 0 0 0 0
6 0.0 3 1.0 2 1.0 0 0 0 0
8 0.0 4 1.0 3 1.0 0 0 0 0
4 0.0 2 1.0 2 0.9 0 0 0 0
28 0.0 40 0.0 0 0.0 1 0 0 0
29 0.0 3 1.0 0 0.0 1 0 0 0
28 0.0 2 1.0 40 0.0 1 0 0 0
20 0.0 18 0.0 22 0.0 1 0 0 0
50 0.0 60 0.0 45 0.0 1 0 0 0
25 0.0 20 0.0 15 0.0 1 1 0 0
3 0.0 2 0.0 2 0.0 0 1 0 1
2 0.0 0 0.0 3 0.0 0 1 0 1
5 0.0 3 1.0 4 0.0 0 1 1 1
4 0.0 4 0.0 3 0.0 0 1 0 1
6 0.0 30 0.9 40 0.9 0 0 0 0
9 0.0 25 1.0 18 1.0 0 0 0 0
5 0.0 45 0.95 36 1.0 0 0 1 0
14 0.2 20 0.9 22 1.0 0 0 0 0
12 0.1 24 1.0 30 0.9 0 0 0 0
40 0.0 30 1.0 35 0.0 0 0 0 1
18 0.0 45 1.0 30 0.0 0 0 0 1
6 0.0 36 1.0 25 0.0 0 0 1 1
12 0.0 30 0.9 25 0.8 0 1 0 1
9 0.0 25 1.0 3 1.0 0 1 0 1
7 0.0 3 0.0 9 0.0 0 0 0 1
6 0.0 4 0.0 12 0.0 0 0 0 1
8 0.0 5 0.0 20 0.0 0 0 0 1
6 0.0 0 0.0 22 0.0 0 0 0 1
9 0.0 8 0.0 3 0.0 0 0 0 1
6 0.0 7 0.0 2 0.0 0 0 0 1
8 0.0 20 0.0 0 0.0 0 0 0 1
6 0.0 28 0.9 2 1.0 0 0 0 0
2 0.0 0 0.0 6 0.0 0 0 1 1
6 0.0 2 0.0 5 0.0 0 0 0 1
5 0.0 6 0.0 0 0.0 0 0 0 1
6 0.0 6 0.0 0 0.0 0 0 0 1
4 1.0 40 0.0 5 1.0 0 0 1 0
9 1.0 5 1.0 4 1.0 0 0 0 0
11 1.0 60 0.0 12 1.0 0 1 0 0
"""


@cache
def tree(depth: int = 8, leaf: int = 1) -> tuple:
    """Nested (feature, threshold, left, right), with True or False at the leaves."""
    table = np.array([[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()])
    x, y = table[:, :-1], table[:, -1]

    def gini(part: np.ndarray) -> float:
        return len(part) * 2 * part.mean() * (1 - part.mean()) if len(part) else 0.0

    def grow(rows: np.ndarray, left: int) -> tuple | bool:
        best = (gini(y[rows]) - 1e-9, None, None)
        for f in (6, 7, 1, 0, 3, 5, 2, 4, 8):
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[rows, f] <= cut
                if min(low.sum(), (~low).sum()) >= leaf and (g := gini(y[rows][low]) + gini(y[rows][~low])) < best[0] - 1e-9:
                    best = (g, f, cut)
        if not left or best[1] is None:
            return bool(y[rows].mean() >= 0.5)
        low = x[rows, best[1]] <= best[2]
        return best[1], float(best[2]), grow(rows[low], left - 1), grow(rows[~low], left - 1)

    return grow(np.arange(len(y)), depth)


def _stands_for(token: str) -> str:
    """What a class, id or role names: itself, or its last piece without counts and suffixes; empty if it is about
    something else, as has-sidebar."""
    pieces = [x for x in re.split(r"[^a-z]+", token) if x]
    if not _MODIFIERS.isdisjoint(pieces):
        return ""
    while len(pieces) > 1 and pieces[-1] in _SUFFIXES:
        pieces.pop()
    return pieces[-1] if pieces else ""


def _named_other(tag: str, attrs: str, in_article: bool) -> bool:
    values: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        values.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower())
    if tag not in ("html", "body") and (values.get("hidden", "false") != "false" or values.get("aria-hidden") == "true" or _NONE.search(values.get("style", ""))):
        return True
    if tag in _ROOTS:
        return False
    words = {_stands_for(t) for x in ("class", "id", "role") for t in values.get(x, "").split()}
    return not words.isdisjoint(_OTHER_WORDS) or not in_article and not words.isdisjoint(_HEADERS)


def blocks(html: str) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, link density, in another container, in an article, heading) of each block with text, in order."""
    out: list[tuple[str, int, float, bool, bool, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, in another container, in an article
    parts: list[str] = []
    linked, heading, at = 0, False, 0
    link: int | None = None  # how many elements were open where the link began; it ends with them at the latest

    def text(raw: str) -> None:
        nonlocal linked
        raw = unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if link is not None:
            linked += len(raw.split())

    def flush() -> None:
        nonlocal linked, parts
        if parts and (words := "".join(parts).split()):
            _, other, article = open_[-1] if open_ else ("", False, False)
            out.append((" ".join(words), len(words), min(1.0, linked / len(words)), other, article, heading))
        parts, linked = [], 0

    for m in _tokens(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->") or m["skip"] and not (m["whole"] or m["close"]):
                at = len(html)  # it has no end
            elif m["skip"]:
                parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a" and (m["end"] or _HREF.search(m["attrs"])):
                link = None if m["end"] else len(open_)
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m["end"]:
            if any(t == tag for t, _, _ in open_):
                while open_.pop()[0] != tag:
                    pass
            heading = False
        elif tag not in _VOID and not m["attrs"].endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == tag:
                open_.pop()  # these end where the next one begins
            if link is not None and link > len(open_):
                link = None
            _, other, article = open_[-1] if open_ else ("", False, False)
            other = other or tag in _OTHER_TAGS or tag == "header" and not article or _named_other(tag, m["attrs"], article or tag in ("article", "main", "body", "html"))
            open_.append((tag, other, article or tag in ("article", "main")))
            heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if link is not None and link > len(open_):
            link = None
    rest = html[at:]
    text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def _tokens(html: str) -> Iterator[re.Match]:
    """The tokens of a page in order, up to its last >: there is no tag behind it."""
    at, last, pattern = 0, html.rfind(">") + 1, _TOKEN
    while at < last and (m := pattern.search(html, at, last)):
        yield m
        at = m.end()
        if pattern is _TOKEN and not m["tag"] and re.match("</?[a-zA-Z]", m[0]) and not m["skip"]:
            pattern = _UNQUOTED


def main_text(html: str | None) -> str:
    """The content blocks of a page, two line feeds between them."""
    found = blocks(html or "")
    kept = []
    none = ("", 0, 0.0, False, False, False)
    for i, (words, n, density, other, article, heading) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        row = (n, density, before[1], before[2], after[1], after[2], other, article, heading)
        node = tree()
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(words)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of ``pages``. Null and empty pages give an empty text; text without
    any markup is one block. Unclosed tags, comments and scripts reach to the page's end. Other columns are ignored."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_batches(rows, one, "page_id long, url string, text string, n_chars long")
