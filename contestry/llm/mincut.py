"""Main text of a page by minimum-cut labelling of its blocks.

A classifier's costs are the terminal capacities, adjacency and closeness in the document tree
the smoothness edges; the maximum flow separates content from boilerplate. Pages are
independent, so a page's small graph is solved where the page is read.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html import unescape
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template noscript svg math object canvas audio video select datalist button".split())
#: An open element of the right side is ended by the start of one of the left.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART = frozenset("nav footer aside form menu dialog search fieldset".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs"
    " topbar toolbar sidebar aside widget related recommended footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe signup login share sharing social comment comments commentlist reply replies disqus responses discussion pagination pager copyright legal skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    parent: int  # the element that holds the block's element
    depth: int
    inside: bool  # within article or main
    apart: bool  # within an element, role or name that is no article text


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of visible text in page order, character references decoded and white
    space made single spaces. Wrong nesting closes what it can and ignores the rest."""
    out: list[Block] = []
    # open elements: name, number, inside, apart, hidden
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    serial, links, parts, linked = 0, 0, [], 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, min(linked, len(text)), top[0], stack[-2][1] if len(stack) > 1 else 0, len(stack), top[2], top[3]))
            parts, linked = [], 0

    def close(at: int) -> None:
        nonlocal links
        flush()
        del stack[at:]
        links = 0

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1][4]:
            said = unescape(html[at:stop])
            parts.append(said)
            if links:
                linked += len(said.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name == "a":
            links = 0 if closing else 1
        if name in RAW and not closing:
            ending = RAW_END[name].search(html, at)
            at = ending.end() if ending else end
            continue
        if name == "br":
            parts.append(" ")
            continue
        holds = name in BLOCKS or name in HIDDEN
        if not holds:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                flush()
            continue
        if name in VOID:
            flush()
            continue
        if name in BLOCKS:
            flush()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            ended = ENDS.get(name)
            while ended and stack[-1][0] in ended:
                close(len(stack) - 1)
        _, _, inside, apart, hidden = stack[-1]
        serial += 1
        if attributes:
            for a in NAMED.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    hidden = True
                elif key == "role":
                    apart = apart or value in ROLES
                elif key != "aria-hidden" and value and name not in ("body", "html", "main") and not NAMES.isdisjoint(PARTS.split(value)):
                    apart = True
        apart = apart or name in APART or (name == "header" and not inside)
        stack.append((name, serial, inside or name in ("article", "main"), apart, hidden or name in HIDDEN))
    flush()
    return out


def content_odds(b: Block) -> float:
    """The classifier: log odds that the block is article text."""
    words = b.text.count(" ") + 1
    odds = 0.9 * log(words) - 1.6 - 4.0 * b.linked / len(b.text)
    odds += 4.0 if b.inside else 0.0
    odds += {"p": 0.8, "pre": 0.8, "blockquote": 0.8, "h1": 0.6, "h2": 0.4, "h3": 0.4, "li": -0.4, "td": -0.3}.get(b.tag, 0.0)
    if b.text[-1] in ".!?…:;\"”»":
        odds += 0.5
    if "©" in b.text or "all rights reserved" in b.text.lower():
        odds -= 3.0
    return odds - 30.0 if b.apart else odds


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours on the page, the more the closer in the tree, and the nearest
    earlier block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            out.append((i - 1, i, 1.2 if a.parent == b.parent else 0.6 / (1 + abs(a.depth - b.depth))))
        if (k := last.get(b.parent)) is not None and k < i - 1:
            out.append((k, i, 0.8))
        last[b.parent] = i
    return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side. Positive odds are capacity from the source,
    negative to the sink; flow is sent along shortest paths, a level graph at a time."""
    n = len(odds)
    give, take = [max(0.0, o) for o in odds], [max(0.0, -o) for o in odds]
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque()
        for v in range(n):
            if give[v] > tiny:
                level[v] = 0
                queue.append(v)
        reached = False
        while queue:
            v = queue.popleft()
            reached = reached or take[v] > tiny
            for e in near[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while give[s] > tiny:
                path: list[int] = []
                v = s
                while take[v] <= tiny:
                    while turn[v] < len(near[v]):
                        e = near[v][turn[v]]
                        if room[e] > tiny and level[to[e]] == level[v] + 1:
                            break
                        turn[v] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        v = to[e ^ 1]
                        turn[v] += 1
                        continue
                    path.append(e)
                    v = to[e]
                else:
                    flow = min([give[s], take[v], *(room[e] for e in path)])
                    give[s] -= flow
                    take[v] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    continue
                break


def main_text(html: str | None) -> str:
    """The content blocks, one a line; empty for null and empty pages and where none is content."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    content = minimum_cut([content_odds(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, content, strict=True) if k)


def extracted(html: Column) -> Column:
    """:func:`main_text` of a column. Each page stands alone: repeated rows and urls, null ids
    and other columns change nothing, and no page is cut short."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return text(html)


def extract_pages(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``, one row for each row."""
    done = pages.select(F.struct(*keep).alias("row"), extracted(F.col(html)).alias("text"))
    return done.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
