"""URL functions.

``canonical`` is the native form for absolute URLs: regular expressions and
array functions that stay inside code generation. ``canonicalize`` also takes
a base, removes dot segments and follows ``java.net.URI`` on malformed input;
it is an Arrow UDF, for links only.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")
TRACKING_PREFIX = "utm_"
ATS_DOMAINS = ("greenhouse.io", "lever.co", "myworkdayjobs.com", "ashbyhq.com", "smartrecruiters.com", "icims.com", "jobvite.com", "workable.com")
CAREER_TERMS = ("job", "jobs", "career", "careers", "position", "opening", "opportunity", "apply")
DEFAULT_PORTS = {"http": 80, "https": 443}

URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Host as written, without user info and port; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":[0-9]*$", "")
    return F.nullif(bare, F.lit(""))


def has_user_info(url: Column) -> Column:
    return authority(url).contains("@")


def port(url: Column) -> Column:
    """Explicit port, or null."""
    return F.nullif(F.regexp_extract(authority(url), r":([0-9]+)$", 1), F.lit("")).cast("int")


def raw_path(url: Column) -> Column:
    return _part(url, 3)


def raw_query(url: Column) -> Column:
    """Query without its mark; null if there is no mark."""
    q = _part(url, 4)
    return F.when(q.startswith("?"), F.substring(q, 2, 1 << 30))


def effective_port(url: Column) -> Column:
    return F.coalesce(port(url), F.when(scheme(url) == "https", 443).otherwise(80))


def origin(url: Column) -> Column:
    """``scheme://host[:port]``, for robots files."""
    return F.concat(scheme(url), F.lit("://"), F.lower(host(url)), F.coalesce(F.concat(F.lit(":"), port(url).cast("string")), F.lit("")))


def limiter_key(url: Column) -> Column:
    """``scheme://authority`` as it stands, for the rate limiter."""
    return F.concat(_part(url, 1), F.lit("://"), authority(url))


def robots_target(url: Column) -> Column:
    """Raw path (``/`` if blank) and raw query, for robots rules."""
    path = raw_path(url)
    return F.concat(F.when(F.trim(path) == "", "/").otherwise(path), F.coalesce(F.concat(F.lit("?"), raw_query(url)), F.lit("")))


def canonical_query(query: Column) -> Column:
    """Query without tracking parameters, sorted; null if nothing is left."""
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (F.trim(p) != "") & ~key(p).startswith(TRACKING_PREFIX) & ~key(p).isin(*TRACKING_KEYS),
    )
    return F.nullif(F.array_join(F.array_sort(kept), "&"), F.lit(""))


def canonical(url: Column) -> Column:
    """Normal form of an absolute URL without dot segments; else null.

    Lower-case scheme and host, no default port, ``/`` for an empty path, no
    fragment, canonical query. Null for other schemes, no host, or user info.
    """
    u = F.trim(url)
    p = port(u)
    shown = F.when(p.isNull() | ((scheme(u) == "http") & (p == 80)) | ((scheme(u) == "https") & (p == 443)), "").otherwise(F.concat(F.lit(":"), p.cast("string")))
    path = F.regexp_replace(raw_path(u), "/{2,}", "/")
    path = F.replace(F.when(path == "", "/").otherwise(path), F.lit("%"), F.lit("%25"))
    query = F.replace(canonical_query(raw_query(u)), F.lit("%"), F.lit("%25"))
    whole = F.concat(scheme(u), F.lit("://"), F.lower(host(u)), shown, path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when(scheme(u).isin("http", "https") & host(u).isNotNull() & ~has_user_info(u), whole)


def same_host(a: Column, b: Column) -> Column:
    """Strict boundary: equal host and effective port; scheme may differ."""
    return F.coalesce((F.lower(host(a)) == F.lower(host(b))) & (effective_port(a) == effective_port(b)), F.lit(False))


def _bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def same_organization(a: Column, b: Column) -> Column:
    """Wide boundary: equal host or one is a subdomain of the other."""
    x, y = F.concat(F.lit("."), _bare_host(a)), F.concat(F.lit("."), _bare_host(b))
    return F.coalesce(x.endswith(y) | y.endswith(x), F.lit(False))


def is_ats(url: Column) -> Column:
    """Host is, or is below, a known applicant-tracking domain."""
    return F.coalesce(F.lower(host(url)).rlike(r"(^|\.)(" + "|".join(map(re.escape, ATS_DOMAINS)) + ")$"), F.lit(False))


def company_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def decoded(part: Column) -> Column:
    """Percent-decoded text (a plus sign stays)."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def career_signal(url: Column, anchor: Column) -> Column:
    """A career term in the decoded path, decoded query or anchor text."""
    text = F.concat_ws(" ", F.coalesce(decoded(raw_path(url)), F.lit("")), F.coalesce(decoded(raw_query(url)), F.lit("")), F.coalesce(anchor, F.lit("")))
    return F.lower(text).rlike("|".join(CAREER_TERMS))


def career_follow(seed: Column, current: Column, candidate: Column, anchor: Column) -> Column:
    near = same_organization(seed, candidate) | same_organization(current, candidate) | is_ats(candidate)
    return scheme(candidate).isin("http", "https") & host(candidate).isNotNull() & career_signal(candidate, anchor) & near


def career_redirect(seed: Column, target: Column) -> Column:
    return same_organization(seed, target) | is_ats(target)


def private_address(ip: Column, strict: bool = False) -> Column:
    """Literal addresses that a crawler must not reach.

    Any-local, loopback, link-local, site-local and multicast, for IPv4,
    IPv6 and IPv4-mapped IPv6. ``strict`` also blocks shared, benchmark,
    reserved and unique-local ranges.
    """
    text = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    v4 = F.regexp_replace(text, r"^::ffff:(?=[0-9]+\.)", "")
    bad4 = r"^(0+\.0+\.0+\.0+$|0*(127|10|22[4-9]|23[0-9])\.|0*169\.0*254\.|0*172\.0*(1[6-9]|2[0-9]|3[01])\.|0*192\.0*168\."
    bad6 = "^(::|::1|fe[89abcdef][0-9a-f]:.*|ff.*"
    if strict:
        bad4 += r"|0+\.|0*100\.0*(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|0*198\.0*1[89]\.|0*(2[4-9][0-9]|[3-9][0-9]{2})\."
        bad6 += "|f[cd][0-9a-f]{2}:.*|64:ff9b:.*"
    return F.when(v4.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), v4.rlike(bad4 + ")")).when(text.contains(":"), text.rlike(bad6 + ")$"))


# --- general form -----------------------------------------------------------

_SPLIT = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.DOTALL)
_ESCAPE = r"%[0-9A-Fa-f]{2}|[^\x00-\xa0  -     　]"
_PATH_OK = re.compile(rf"(?:[A-Za-z0-9\-_.!~*'();/:@&=+$,]|{_ESCAPE})*\Z")
_URIC_OK = re.compile(rf"(?:[A-Za-z0-9\-_.!~*'();/?:@&=+$,\[\]]|{_ESCAPE})*\Z")
_HOST_OK = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)*[A-Za-z](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.?\Z")
_IPV4_OK = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\Z")


def without_dots(path: str) -> str:
    """Path without ``.`` and inner ``..`` segments and repeated slashes.

    A ``..`` with nothing left to remove stays.
    """
    out: list[str] = []
    parts = [p for p in path.split("/") if p != ""]
    for p in parts:
        if p == "..":
            if out and out[-1] != "..":
                out.pop()
            else:
                out.append(p)
        elif p != ".":
            out.append(p)
    slash = path.endswith("/") or (parts and parts[-1] in (".", "..") and bool(out) and out[-1] != "..")
    text = "/".join(out)
    return ("/" if path.startswith("/") else "") + text + ("/" if slash and text else "")


def _split(text: str) -> tuple | None:
    """Scheme, authority, path, query; None if a character isn't allowed."""
    m = _SPLIT.match(text)
    if not m:
        return None
    s, a, p, q, f = m.groups()
    if not _PATH_OK.match(p) or any(x is not None and not _URIC_OK.match(x) for x in (q, f)) or (a is not None and not _URIC_OK.match(a)):
        return None
    if s is not None and a is None and not p.startswith("/"):
        return (s, None, None, None) if p or q else None  # opaque, such as mailto:
    return s, a, p, q


def canonical_text(base: str | None, raw: str | None) -> str | None:
    """Normal form of ``raw``, resolved against ``base``; None to drop it."""
    if raw is None or not raw.strip():
        return None
    child = _split(raw.strip())
    if child is None:
        return None
    s, a, p, q = child
    if base is not None and s is None:
        parent = _split(base)
        if parent is None:
            return None
        bs, ba, bp, bq = parent
        if a is None:
            if p == "" and q is None:
                p, q = bp, bq
            elif not (p or "").startswith("/"):
                p = without_dots((bp or "")[: (bp or "").rfind("/") + 1] + p)
            a = ba
        s = bs
    s = (s or "").lower()
    if s not in DEFAULT_PORTS or not a or p is None:
        return None
    m = re.match(r"(?:(.*)@)?(\[[^\]]*\]|[^:@\[\]]*)(?::(\d*))?\Z", a)
    if not m or m[1] is not None:
        return None
    name = m[2]
    if not (_HOST_OK.match(name) or _IPV4_OK.match(name) or name.startswith("[")):
        return None
    number = int(m[3]) if m[3] else None
    shown = "" if number in (None, DEFAULT_PORTS[s]) else f":{number}"
    path = (without_dots(p) or "/").replace("%", "%25")
    kept = []
    for part in (q or "").split("&"):
        key = part.split("=", 1)[0].lower()
        if part.strip() and not key.startswith(TRACKING_PREFIX) and key not in TRACKING_KEYS:
            kept.append(part)
    query = "&".join(sorted(kept)).replace("%", "%25")
    return f"{s}://{name.lower()}{shown}{path}{'?' + query if kept else ''}"


def _canonicalize(base: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(b, r) for b, r in zip(base, raw)], dtype="object")


def canonicalize(base: Column | str, raw: Column | str) -> Column:
    """``canonical_text`` of two columns."""
    return F.pandas_udf(_canonicalize, "string")(base, raw)


def canonical_seed(raw: str) -> str:
    """Normal form of a seed; raises ValueError unless it is absolute HTTP(S)."""
    found = canonical_text(None, raw)
    if found is None:
        raise ValueError("seed URL must be an absolute HTTP(S) URL")
    return found
