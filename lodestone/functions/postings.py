"""Job-posting extraction: JSON-LD first, then a page heuristic."""

from __future__ import annotations

import json
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scoring, skills
from lodestone.functions.html import DESCRIPTION_PLACES, LOCATION_PLACES, Page, clean_html

MAX_DESCRIPTION = 30_000
MIN_DESCRIPTION = 120
MAX_LOCATION = 500
PATH_TERMS = ("job", "career", "position", "opening")


def scalar_text(value) -> str:
    """JSON scalars as text, the way a JSON library prints them."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def joined_text(value) -> str:
    """Scalar as text; an array's or object's non-blank values joined."""
    if isinstance(value, (list, dict)):
        parts = (joined_text(v) for v in (value.values() if isinstance(value, dict) else value))
        return ", ".join(p for p in parts if p.strip())
    return scalar_text(value)


def field_text(node, name: str) -> str:
    return joined_text(node.get(name)) if isinstance(node, dict) else ""


def is_type(value, want: str = "jobposting") -> bool:
    items = value if isinstance(value, list) else [value]
    return any(isinstance(x, (str, int, float, bool)) and scalar_text(x).lower() == want for x in items)


def postings_in(node) -> list[dict]:
    """Posting nodes, through arrays and ``@graph`` only."""
    if isinstance(node, list):
        return [p for x in node for p in postings_in(x)]
    if not isinstance(node, dict):
        return []
    own = [node] if is_type(node.get("@type")) else []
    return own + (postings_in(node["@graph"]) if "@graph" in node else [])


def places_of(node) -> list[str]:
    """Location texts of a location node, in order."""
    if isinstance(node, list):
        return [p for x in node for p in places_of(x)]
    if node is None:
        return []
    address = node["address"] if isinstance(node, dict) and "address" in node else node
    if isinstance(address, str):
        return [address]
    if not isinstance(address, dict):
        return []
    parts = [t for t in (field_text(address, f"address{k}") for k in ("Locality", "Region", "Country")) if t.strip()]
    if parts:
        return [", ".join(parts)]
    name = field_text(node, "name")
    return [name] if name.strip() else []


def location_of(node: dict) -> str:
    places = places_of(node.get("jobLocation")) or places_of(node.get("applicantLocationRequirements"))
    kind = node.get("jobLocationType")
    if not isinstance(kind, (dict, list)) and "TELECOMMUTE" in scalar_text(kind).upper():
        places = [*places, "Remote"]
    return "; ".join(dict.fromkeys(p for p in places if p.strip())) or "Not specified"


def structured(page: Page) -> dict | None:
    """Fields of the first JSON-LD posting; scripts that don't parse are passed over."""
    for kind, data in page.scripts:
        if kind.strip().lower() != "application/ld+json":
            continue
        try:
            found = postings_in(json.loads(data))
        except (ValueError, RecursionError):
            continue
        if found:
            node = found[0]
            org = node.get("hiringOrganization")
            org = org[0] if isinstance(org, list) and org else org
            return {
                "title": next((t.strip() for t in (field_text(node, "title"), field_text(node, "name")) if t.strip()), "Untitled role"),
                "company": field_text(org, "name"),
                "location": location_of(node),
                "employment_type": joined_text(node.get("employmentType")),
                "experience": field_text(node, "experienceRequirements"),
                "description": clean_html(field_text(node, "description")),
                "skill_text": " ".join((field_text(node, "skills"), field_text(node, "qualifications"))),
                "method": "JSON_LD",
            }
    return None


def heuristic(page: Page, url: str) -> dict | None:
    """Fields of a page that looks like a posting by its path and length."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:  # a malformed bracketed host
        return None
    path = unquote(parts.path).lower()
    title = next((t.strip() for t in (page.h1 or "", page.meta("og:title"), page.title or "") if t.strip()), "")
    if not title or not any(t in path for t in PATH_TERMS):
        return None
    description = page.first(DESCRIPTION_PLACES) or ""
    if len(description) < MIN_DESCRIPTION:
        return None
    return {
        "title": title,
        "company": next((t.strip() for t in (page.meta("og:site_name"), host.removeprefix("www.")) if t.strip()), ""),
        "location": (page.first(LOCATION_PLACES) or "").strip()[:MAX_LOCATION],
        "employment_type": "",
        "experience": "",
        "description": description,
        "skill_text": "",
        "method": "HEURISTIC",
    }


FIELDS = "title string, company string, location string, employment_type string, experience string, description string, skill_text string, method string"


def fields_of(page: Page, url: str) -> dict | None:
    return structured(page) or heuristic(page, url)


def _raw_posting(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows = []
    for u, h in zip(url, html):
        rows.append(fields_of(Page(h or ""), u or "") or dict.fromkeys(names))
    return pd.DataFrame(rows, columns=names)


def raw_posting(url: Column, html: Column) -> Column:
    """Fields of the page's posting as a struct; all null if there is none."""
    return F.pandas_udf(_raw_posting, FIELDS)(url, html)


def posting(url: Column, html: Column) -> Column:
    """Posting struct of a page, or null.

    The tree walk is Python; experience, role titles and skills are native.
    """
    return posting_of(raw_posting(url, html))


def posted(pages: DataFrame, key: str) -> DataFrame:
    """``pages(key, url, html)`` to ``(key, p)`` of the pages that have a posting; each page is parsed once."""
    parse = F.pandas_udf(_raw_posting, FIELDS).asNondeterministic()  # else the filter gets a parse of its own, before any shuffle
    return pages.select(key, parse("url", "html").alias("raw")).select(key, posting_of(F.col("raw")).alias("p")).where("p is not null")


def posting_of(raw: Column) -> Column:
    """Posting struct of a page's fields, or null."""
    experience = scoring.first_non_blank(raw["experience"], scoring.experience(raw["description"]), F.lit("Not specified"))
    text = F.when(raw["method"] == "HEURISTIC", raw["description"]).otherwise(F.concat_ws(" ", raw["description"], raw["skill_text"], experience))
    found = F.struct(
        raw["title"].alias("title"), raw["company"].alias("company"), raw["location"].alias("location"),
        skills.detect(text).alias("skills"), experience.alias("experience"), raw["employment_type"].alias("employment_type"),
        scoring.truncated(raw["description"], MAX_DESCRIPTION).alias("description"), raw["method"].alias("extraction_method"),
    )
    return F.when((raw["method"] == "JSON_LD") | ((raw["method"] == "HEURISTIC") & scoring.is_role_title(raw["title"])), found)
