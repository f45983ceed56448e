"""Scores, waits and small text functions of the matching and retry rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RETRY_SECONDS = 60
EXPERIENCE = r"(?i)(?<![A-Za-z0-9_])(\d+\+?\s*(?:-|to)?\s*\d*\s*years?(?:\s+of)?(?:\s+[\p{L}][\p{L}/&\-]*){0,6}\s+experience)(?![A-Za-z0-9_])"
# The summaries of a match.
NO_SKILLS = "The posting did not expose enough recognized skills for a high-confidence score."
COUNTED = ("", " of ", " recognized job skills appear in the resume.")
# Words that mark a role title, in order.
ROLE_WORDS = (
    "engineer", "developer", "architect", "scientist", "analyst", "manager", "director", "designer", "consultant", "specialist",
    "administrator", "coordinator", "representative", "recruiter", "technician", "intern", "lead", "product", "marketing", "sales", "operations",
)


def match_score(matched: Column, total: Column) -> Column:
    """35 without job skills, else 20 to 100 by the matched share, half up."""
    share = F.floor(20 + F.lit(80.0) * matched / F.nullif(total, F.lit(0)) + 0.5).cast("int")
    return F.when(total == 0, 35).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), share)))


def match_summary(matched: Column, total: Column) -> Column:
    before, between, after = COUNTED
    return F.when(total == 0, NO_SKILLS).otherwise(F.concat(F.lit(before), matched.cast("string"), F.lit(between), total.cast("string"), F.lit(after)))


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def retry_after(text: Column) -> Column:
    """Whole seconds of a Retry-After header; dates and junk give 0."""
    return F.greatest(F.lit(0), F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0)))


def backoff_seconds(attempts: Column, server_seconds: Column, base: int = 2, most: int = MAX_RETRY_SECONDS) -> Column:
    """Wait before the next attempt: doubling, at least the server's, capped."""
    doubled = F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1))
    return F.least(F.lit(float(most)), F.greatest(server_seconds.cast("double"), doubled)).cast("long")


def retry_wait_ms(milliseconds: Column) -> Column:
    return F.greatest(F.lit(25), F.least(F.lit(500), milliseconds))


def experience(text: Column) -> Column:
    """First phrase of years of experience, or empty."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), EXPERIENCE, 1)


def is_role_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)(?<![A-Za-z0-9_])(" + "|".join(ROLE_WORDS) + r")(?![A-Za-z0-9_])")


def first_non_blank(*values: Column) -> Column:
    """First value that isn't blank, trimmed; else empty."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values), F.lit(""))


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def preview(text: Column, most: int = 600) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def fingerprint(body: Column) -> Column:
    return F.sha2(body, 256)
