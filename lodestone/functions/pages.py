"""All that a crawl asks of a page, from one parse of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import html, postings
from lodestone.functions.urls import canonical_text

LINKS = "array<struct<url: string, anchor: string>>"


def page_facts(url: Column | str, body: Column | str, career: bool = False) -> Column:
    """Struct of title, text, links (resolved, in document order) and, for careers, the raw posting."""

    def read(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for u, h in zip(urls, bodies):
            page = html.Page(h or "")
            found = ((canonical_text(u, href), anchor) for href, anchor in page.links)
            links = [{"url": x, "anchor": t} for x, t in found if x is not None]
            rows.append((page.title or "", page.body_text(), links, *(((postings.fields_of(page, u or "") or {}).get(n) for n in NAMES) if career else [None] * len(NAMES))))
        return pd.DataFrame(rows, columns=["title", "text", "links", *(f"posting_{n}" for n in NAMES)])

    fields = ", ".join(f"posting_{f}" for f in postings.FIELDS.split(", "))
    return F.pandas_udf(read, f"title string, text string, links {LINKS}, {fields}")(url, body)


NAMES = [f.split()[0] for f in postings.FIELDS.split(", ")]


def posting_of(facts: Column) -> Column:
    """Posting struct of a page's facts, or null."""
    return postings.posting_of(F.struct(*(facts[f"posting_{n}"].alias(n) for n in NAMES)))
