"""Classification of fetched responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BODY_CAP = 1_500_000


def content_type(header: Column) -> Column:
    return F.lower(F.coalesce(header, F.lit("application/octet-stream")))


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


def is_redirect(status: Column) -> Column:
    return status.isin(301, 302, 303, 307, 308)


def is_html(kind: Column) -> Column:
    return F.coalesce(kind.contains("text/html") | kind.contains("application/xhtml+xml"), F.lit(False))


def within_cap(body: Column, cap: int = BODY_CAP) -> Column:
    return F.octet_length(body) <= cap


def outcome(status: Column, kind: Column, attempts: Column, max_attempts: int = 3) -> Column:
    """Next frontier state of a response; the order of the tests matters."""
    return (
        F.when(is_retryable(status), F.when(attempts >= max_attempts, "FAILED").otherwise("RETRY"))
        .when(~is_success(status), "FAILED")
        .when(~is_html(kind), "SKIPPED")
        .otherwise("DONE")
    )


def outcome_message(status: Column, kind: Column) -> Column:
    return (
        F.when(is_retryable(status) | ~is_success(status), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(~is_html(kind), F.concat(F.lit("Unsupported content type: "), kind))
    )


def error_state(error: Column, attempts: Column, max_attempts: int = 3) -> Column:
    """Next frontier state of an error kind."""
    retry = F.when(attempts >= max_attempts, "FAILED").otherwise("RETRY")
    return F.when(error.isin("blocked", "unsafe"), "SKIPPED").when(error.isin("retryable", "io"), retry).when(error == "illegal_argument", "FAILED")


def block_reason(career: Column, same_host_only: Column, redirect_ok: Column, same_host: Column, robots_ok: Column) -> Column:
    """Why a request may not be sent, or null; the order of the tests matters."""
    return (
        F.when(career & ~redirect_ok, "Redirect left the careers site or supported ATS hosts")
        .when(~career & same_host_only & ~same_host, "Redirect left the permitted host")
        .when(~robots_ok, "Blocked by robots.txt")
    )
