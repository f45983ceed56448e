"""HTML text, titles, links and elements (Arrow UDFs over the page's tree).

Text joins with a space at block boundaries, script and style data is skipped,
entities are decoded. A page is parsed once for all that is asked of it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.dom import Node, parse, select
from lodestone.functions.urls import canonical_text

# Elements whose edges separate words, and elements without text.
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset(("script", "style", "template"))

# Where descriptions and places are looked for, in turn; bodies go last.
DESCRIPTION_PLACES = ("[class*=job-description]", "[id*=job-description]", "main", "article", "body")
LOCATION_PLACES = ("[class*=job-location]", "[class*=location]", "[data-testid*=location]")


def text_of(node: Node) -> str:
    """Text of an element, white space as one space."""
    out, waiting = [], [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in SILENT:
            if x.tag in BLOCKS:
                out.append(" ")
                waiting.append(" ")
            waiting.extend(reversed(x.children))
    return " ".join("".join(out).split())


class Page:
    """What the extractors need of a page, in document order; parsed once."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.body = self.root.children[1]
        by_tag: dict[str, list[Node]] = {"title": [], "h1": [], "a": [], "meta": [], "script": []}
        for node in self.root.elements():
            if node.tag in by_tag:
                by_tag[node.tag].append(node)
        self.title, self.h1 = (text_of(by_tag[t][0]) if by_tag[t] else None for t in ("title", "h1"))
        self.metas = [n.attributes for n in by_tag["meta"]]
        self.scripts = [(n.attributes.get("type", ""), "".join(n.children)) for n in by_tag["script"]]
        self._anchors = by_tag["a"]

    @property
    def links(self) -> list[tuple[str, str]]:
        """Targets and texts of the anchors that have a target."""
        return [(href, text_of(n)) for n in self._anchors if (href := n.attributes.get("href")) is not None]

    def body_text(self) -> str:
        """Text of everything but the head."""
        return text_of(self.body)

    def first(self, places: tuple[str, ...]) -> str | None:
        """Text of the first element of the first selector that finds one."""
        for place in places:
            node = next(select(self.root, place), None)
            if node is not None:
                return text_of(node)
        return None

    def meta(self, name: str) -> str:
        return next((m.get("content", "").strip() for m in self.metas if m.get("property", "").strip().lower() == name), "")


_TAG_LIKE = re.compile(r"<[a-zA-Z][^>]*>")


def clean_html(text: str | None) -> str:
    """Text of an HTML fragment; once more if it was escaped twice."""
    once = Page(text or "").body_text()
    return Page(once).body_text() if _TAG_LIKE.search(once) else once


def _page_parts(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        p = Page(h or "")
        rows.append((p.title or "", p.h1 or "", p.body_text(), [{"href": a, "anchor": t} for a, t in p.links]))
    return pd.DataFrame(rows, columns=["title", "h1", "text", "links"])


def page_parts(html: Column | str) -> Column:
    """Title, first heading, body text and links of pages, as a struct."""
    return F.pandas_udf(_page_parts, "title string, h1 string, text string, links array<struct<href: string, anchor: string>>")(html)


def _resolved_links(url: pd.Series, html: pd.Series) -> pd.Series:
    out = []
    for u, h in zip(url, html):
        found = ((canonical_text(u, href), anchor) for href, anchor in Page(h or "").links)
        out.append([{"url": x, "anchor": t} for x, t in found if x is not None])
    return pd.Series(out)


def resolved_links(url: Column | str, html: Column | str) -> Column:
    """Links in document order, resolved and canonical; dropped if they can't be."""
    return F.pandas_udf(_resolved_links, "array<struct<url: string, anchor: string>>")(url, html)


def simple_tag(html: Column, tag: str) -> Column:
    """Content of the first ``<tag>``, natively, for markup without nesting."""
    return F.regexp_extract(html, f"<{tag}[^>]*>([^<]*)</{tag}>", 1)


def hrefs(html: Column) -> Column:
    """Double-quoted hrefs of anchors, natively, in document order."""
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
