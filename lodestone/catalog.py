"""Registry of the engine's own queries and their DuckDB oracles."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import fixtures as fx
from lodestone.functions import fetching, html, postings, scoring, skills, urls
from lodestone.operators import frontier as fr
from lodestone.operators import addresses, bulk_matching, matching, robots, schedule, tables
from lodestone.plans import bfs, crawl, documents
from lodestone.plans.spec import CareerSpec, CrawlSpec
from lodestone.plans.work import Work
from lodestone.sources import export, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, cases: fx.Fixture, table: str, key: str, vary: str | None = None) -> DataFrame:
    """A case of a rule for every row of a table, in turn by its key, which is the id; ``vary``: a text that the key is added to."""
    rows = read(spark, sf_dir, table).select(F.col(key).alias("_key"))
    turn = {r[0]: k for k, r in enumerate(sorted(cases.rows, key=lambda r: r[0]))}
    few = cases.frame(spark).withColumn("_turn", F.element_at(F.create_map(*[F.lit(x) for kv in turn.items() for x in kv]), F.col("id"))).drop("id")
    met = rows.join(F.broadcast(few), F.col("_key") % len(cases.rows) == F.col("_turn"))
    text = {vary: F.concat(F.col(vary), F.lit(" "), F.col("_key").cast("string"))} if vary else {}
    return met.withColumns(text).select(F.col("_key").alias("id"), *(c for c in cases.columns if c != "id"))


def spread_sql(cases: fx.Fixture, table: str, key: str, vary: str | None = None) -> str:
    kept = [f"{c} || ' ' || {key} AS {c}" if c == vary else c for c in cases.columns if c != "id"]
    return f"(SELECT {key} AS id, {', '.join(kept)} FROM {table} JOIN (SELECT *, row_number() OVER (ORDER BY id) - 1 AS turn FROM {cases.sql()}) ON {key} % {len(cases.rows)} = turn)"


JOB_SKILLS = ("Java", "SQL", "Spring Boot", "Kafka", "AWS", "Terraform")
PART_JOBS = f"""(SELECT 'job-' || p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand || ' "' || p_size || '"' END AS company, p_type AS location,
    list_filter([{', '.join(f"CASE WHEN p_partkey % {k + 2} = 0 THEN {fx.literal(n)} END" for k, n in enumerate(JOB_SKILLS))}], lambda x: x IS NOT NULL) AS skills,
    p_size || ' years' AS experience, 'full' || chr(10) || 'time' AS employment_type, 'http://jobs.example/' || p_partkey AS source_url, 'JSON_LD' AS extraction_method,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p_partkey * 37 % 1000 AS INTEGER)) AS discovered_at FROM part)"""


def part_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting for every part."""
    k, s = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    wanted = F.array_compact(F.array(*(F.when(k % (i + 2) == 0, n) for i, n in enumerate(JOB_SKILLS))))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("job-"), s("p_partkey")).alias("id"), F.lit("scan").alias("scan_id"), F.lit("page").alias("page_id"), F.concat(F.lit("http://jobs.example/"), s("p_partkey")).alias("source_url"),
        F.col("p_name").alias("title"), F.when(k % 7 != 0, F.concat("p_brand", F.lit(' "'), s("p_size"), F.lit('"'))).alias("company"), F.col("p_type").alias("location"), wanted.alias("skills"),
        F.concat(s("p_size"), F.lit(" years")).alias("experience"), F.lit("full\ntime").alias("employment_type"), F.col("p_name").alias("description"), F.lit("JSON_LD").alias("extraction_method"),
        F.timestamp_seconds(F.lit(1704067200) + k * 37 % 1000 * 3600).alias("discovered_at"),
    )


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- pages: URLs, links, listings --------------------------------------------

KEPT = "list_filter(string_split(q, '&'), lambda p: trim(p) <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref','ref_src'))"


def canonical_sql(source: str, url: str, keys: str) -> str:
    """Oracle for absolute URLs: ``keys``, ``canonical`` over a table expression."""
    u = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
    return f"""
      SELECT {keys}, s || '://' || h || p || CASE WHEN length(qq) > 0 THEN '?' || qq ELSE '' END AS canonical
      FROM (SELECT *, replace(array_to_string(list_sort({KEPT}), '&'), '%', '%25') AS qq
            FROM (SELECT *, lower(regexp_extract({url}, {u}, 1)) AS s, lower(regexp_extract({url}, {u}, 2)) AS h,
                  CASE WHEN regexp_extract({url}, {u}, 3) = '' THEN '/' ELSE replace(regexp_replace(regexp_extract({url}, {u}, 3), '/+', '/', 'g'), '%', '%25') END AS p,
                  substr(regexp_extract({url}, {u}, 4), 2) AS q FROM {source}))"""


HREFS = """regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)"""


@query(
    f"""
    SELECT canonical, page_id, title, body_sha256, outbound_links
    FROM ({canonical_sql('pages', 'url', "page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, sha256(html) AS body_sha256, CAST(len(list_distinct(" + HREFS + ")) AS INTEGER) AS outbound_links")})"""
)
def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages by canonical URL with title, fingerprint and links."""
    out = read(spark, sf_dir, "pages").select(
        urls.canonical(F.col("url")).alias("canonical"), "page_id", html.simple_tag(F.col("html"), "title").alias("title"),
        scoring.fingerprint(F.col("html")).alias("body_sha256"), F.size(F.array_distinct(html.hrefs(F.col("html")))).alias("outbound_links"),
    )
    return out.orderBy("canonical", "page_id")


@query(canonical_sql("pages", "url", "page_id, url"))
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))


RESOLVED = {  # raw link (``m``, ``k``: numbers) and its normal form
    "../d?z=1&a=2": "https://h<m>.example/a/d?a=2&z=1", "./e#f": "https://h<m>.example/a/b<k>/e", "/f//g": "https://h<m>.example/f/g",
    "//O.example:443/h?utm_x=1": "https://o.example/h", "mailto:x@y.example": None, "HTTP://P.example:80": "http://p.example/",
}


@query("SELECT c_custkey AS id, CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN replace(replace({fx.literal(want)}, '<m>', CAST(c_custkey % 7 AS VARCHAR)), '<k>', CAST(c_custkey AS VARCHAR))" for i, want in enumerate(RESOLVED.values())) + " END AS canonical FROM customer")
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, schemeless and rejected links against bases made of customers."""
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*map(F.lit, RESOLVED)), (k % len(RESOLVED) + 1).cast("int"))
    base = F.concat(F.lit("https://h"), (k % 7).cast("string"), F.lit(".example/a/b"), k.cast("string"), F.lit("/c"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), base.alias("base"), raw.alias("raw")).select("id", urls.canonicalize("base", "raw").alias("canonical"))


@query(canonical_sql("pages", "url", "page_id, url"))
def url_canonicalize_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general form agrees with the native one on absolute URLs."""
    return read(spark, sf_dir, "pages").select("page_id", "url", urls.canonicalize(F.lit(None).cast("string"), "url").alias("canonical"))


@query(
    f"""SELECT id, CASE WHEN s = '' THEN NULL ELSE CASE WHEN port IS NOT NULL THEN port WHEN s = 'https' THEN 443 ELSE 80 END END AS port,
         CASE WHEN s <> '' THEN s || '://' || lower(split_part(a, ':', 1)) || CASE WHEN port IS NOT NULL THEN ':' || port ELSE '' END END AS origin,
         CASE WHEN s <> '' THEN s || '://' || a END AS limiter_key,
         CASE WHEN s <> '' THEN CASE WHEN p = '' THEN '/' ELSE p END || q END AS target
       FROM (SELECT id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS a,
               TRY_CAST(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)', 1), '') AS INTEGER) AS port,
               regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[a-z]+://[^?#]*(\\?[^#]*)', 1) AS q FROM {spread_sql(fx.PORTS, 'supplier', 's_suppkey')})"""
)
def url_parts_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    ok = urls.scheme(u) != ""
    return spread(spark, sf_dir, fx.PORTS, "supplier", "s_suppkey").select(
        "id", F.when(ok, urls.effective_port(u)).alias("port"), F.when(ok, urls.origin(u)).alias("origin"), F.when(ok, urls.limiter_key(u)).alias("limiter_key"), F.when(ok, urls.robots_target(u)).alias("target")
    )


@query(
    f"""SELECT canonical, min(page_id) AS page_id FROM (
        {canonical_sql("(SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=x' FROM pages)", "url", "page_id")}) GROUP BY canonical"""
)
def url_canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of each canonical URL, with tracking variants added."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    u = F.split_part("url", F.lit("#"), F.lit(1))
    variant = pages.select((F.col("page_id") + 1000000).alias("page_id"), F.concat(u, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_campaign=x")).alias("url"))
    both = pages.unionByName(variant).select(urls.canonical(F.col("url")).alias("canonical"), "page_id")
    return tables.keep_first(both, ["canonical"], ["page_id"]).select("canonical", "page_id")


HOST_SQL = "regexp_extract({u}, '^[a-z]+://([^/?#:]*)', 1)"


@query(
    f"""SELECT a.page_id AS a_id, b.page_id AS b_id, {HOST_SQL.format(u='a.url')} = {HOST_SQL.format(u='b.url')} AND split_part(a.url, ':', 1) = split_part(b.url, ':', 1) AS strict,
          (ha = hb OR ends_with(ha, '.' || hb) OR ends_with(hb, '.' || ha)) AS wide
        FROM (SELECT page_id, url, regexp_replace({HOST_SQL.format(u='url')}, '^www\\.', '') AS ha FROM pages) a
        JOIN (SELECT page_id, url, regexp_replace({HOST_SQL.format(u='url')}, '^www\\.', '') AS hb FROM pages) b ON b.page_id = a.page_id + 1"""
)
def host_boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "pages").select(F.col("page_id").alias("a_id"), F.col("url").alias("a"))
    b = read(spark, sf_dir, "pages").select(F.col("page_id").alias("b_id"), F.col("url").alias("b"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", urls.same_host(F.col("a"), F.col("b")).alias("strict"), urls.same_organization(F.col("a"), F.col("b")).alias("wide"))


@query(
    f"""SELECT id, ha = hb AND pa = pb AS strict,
          regexp_replace(ha, '^www\\.', '') = regexp_replace(hb, '^www\\.', '') OR ends_with(regexp_replace(ha, '^www\\.', ''), '.' || regexp_replace(hb, '^www\\.', '')) OR ends_with(regexp_replace(hb, '^www\\.', ''), '.' || regexp_replace(ha, '^www\\.', '')) AS wide,
          regexp_matches(hb, '(^|\\.)(greenhouse\\.io|lever\\.co|myworkdayjobs\\.com|ashbyhq\\.com|smartrecruiters\\.com|icims\\.com|jobvite\\.com|workable\\.com)$') AS ats, regexp_replace(hb, '^www\\.', '') AS company
        FROM (SELECT id, lower({HOST_SQL.format(u='a')}) AS ha, lower({HOST_SQL.format(u='b')}) AS hb,
               coalesce(TRY_CAST(nullif(regexp_extract(a, '^[a-z]+://[^/?#]*:([0-9]+)', 1), '') AS INT), CASE WHEN starts_with(a, 'https') THEN 443 ELSE 80 END) AS pa,
               coalesce(TRY_CAST(nullif(regexp_extract(b, '^[a-z]+://[^/?#]*:([0-9]+)', 1), '') AS INT), CASE WHEN starts_with(b, 'https') THEN 443 ELSE 80 END) AS pb FROM {spread_sql(fx.HOSTS, 'supplier', 's_suppkey')})"""
)
def org_boundary_ats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return spread(spark, sf_dir, fx.HOSTS, "supplier", "s_suppkey").select("id", urls.same_host(a, b).alias("strict"), urls.same_organization(a, b).alias("wide"), urls.is_ats(b).alias("ats"), F.lower(urls.company_of(b)).alias("company"))


@query("SELECT s_suppkey AS id, s_suppkey % 6 IN (0,1,2,5) AND (s_suppkey % 6 IN (0,3,4) OR s_suppkey % 4 IN (0,3)) AS follow, s_suppkey % 6 IN (0,1,2,5) AS redirect FROM supplier")
def career_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of careers pages to own, hosted and foreign places, with and without a career word."""
    k = F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("firm"), k, F.lit(".example"))
    at = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    candidates = F.array(at("https://", own, "/careers/", k), at("https://hire.", own, "/x/", k), at("https://boards.greenhouse.io/b", k, "/", k), at("https://clicks.example/jobs/", k), at("https://xgreenhouse.io/jobs/", k), at("https://www.", own, "/about"))
    anchor = F.element_at(F.array(F.lit("Apply"), F.lit("Read"), F.lit(None), F.lit("Open Position")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), at("https://", own, "/careers").alias("s"), F.element_at(candidates, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("x"), anchor.alias("a"))
    s, x, a = F.col("s"), F.col("x"), F.col("a")
    return rows.select("id", urls.career_follow(s, s, x, a).alias("follow"), urls.career_redirect(s, x).alias("redirect"))


@query(f"SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href FROM (SELECT page_id, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) AS pos FROM pages)")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))


@query(f"SELECT page_id, CAST(len(list_distinct({HREFS})) AS INTEGER) AS outbound_links FROM pages")
def outbound_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the general link extractor and the strict host filter."""
    links = F.filter(html.resolved_links("url", "html"), lambda x: urls.same_host(F.col("url"), x["url"]))
    return read(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.transform(links, lambda x: x["url"]))).alias("outbound_links"))


@query("SELECT page_id, sha256(html) AS body_sha256, octet_length(encode(html)) <= 1500000 AS within_cap FROM pages")
def page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", scoring.fingerprint(F.col("html")).alias("body_sha256"), fetching.within_cap(F.col("html")).alias("within_cap"))


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 100")
def page_listing_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the listing; the limit is the feature."""
    return tables.listing(read(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], 100)


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 600) || '…' END AS preview FROM documents")
def page_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", scoring.preview(F.col("text")).alias("preview"))


@query("""SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h1,
          coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), ''), '') AS heading FROM pages""")
def title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h = html.simple_tag(F.col("html"), "title"), html.simple_tag(F.col("html"), "h1")
    return read(spark, sf_dir, "pages").select("page_id", t.alias("title"), h.alias("h1"), scoring.first_non_blank(h, t).alias("heading"))


@query("SELECT p_partkey AS id, p_name AS title, p_type AS h1, p_type || ' ' || p_brand || ' & x ' || p_size || ' y' || p_size AS text FROM part")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup with entities, unclosed items, inline tags and skipped data, made of parts."""
    markup = F.format_string("<html><head><title>%s</title><style>p{}</style></head><body><h1>%s</h1><p>%s &amp;<br>x<script>z</script><ul><li>%d<li><b>y</b>%d</ul></body></html>", "p_name", "p_type", "p_brand", "p_size", "p_size")
    p = html.page_parts("html")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.alias("html")).select("id", p.alias("p")).select("id", "p.title", "p.h1", "p.text")


#: Text of the page table's markup: heads, data and comments go, block tags separate words.
_PLAIN = """regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '</?(a|b|i|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')"""


def _unescaped_sql(x: str) -> str:
    for entity, code in (("lt", 60), ("gt", 62), ("quot", 34), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
        x = f"regexp_replace({x}, '&{entity};?', chr({code}), 'g')"  # a mark at the end of a cut title is none
    return x


@query(f"""SELECT page_id, {_unescaped_sql("trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1))")} AS title,
           trim(regexp_replace({_unescaped_sql(_PLAIN)}, '[\\s\u00a0]+', ' ', 'g')) AS text, CAST(len({HREFS}) AS INTEGER) AS links FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, body text and links of every page."""
    p = html.page_parts("html")
    return read(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", "p.title", "p.text", F.size("p.links").alias("links"))


FIRST = (10, 127, 169, 172, 192, 198, 100, 230)  # first octets that some rule looks at
_OCTETS = f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 8 THEN o_orderkey * 37 % 256 ELSE {fx.literal(list(FIRST))}[CAST(o_orderkey % 9 + 1 AS INT)] END AS a, CASE WHEN o_custkey % 3 = 0 THEN CASE o_orderkey % 9 WHEN 2 THEN 254 WHEN 4 THEN 168 ELSE 18 END ELSE o_custkey % 256 END AS b FROM orders"


@query(f"""SELECT id, b0 AS blocked, b0 OR a = 0 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR a >= 240 AS blocked_strict FROM (SELECT *,
           a IN (10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a BETWEEN 224 AND 239 AS b0 FROM ({_OCTETS}))""")
def ssrf_ip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of orders; every fifth is written as an IPv4-mapped one."""
    k, r = F.col("o_orderkey"), F.col("o_orderkey") % 9
    a = F.when(r == 8, k * 37 % 256).otherwise(F.element_at(F.array(*map(F.lit, FIRST)), F.least(r + 1, F.lit(8)).cast("int")))
    b = F.when(F.col("o_custkey") % 3 == 0, F.when(r == 2, 254).when(r == 4, 168).otherwise(18)).otherwise(F.col("o_custkey") % 256)
    ip = F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("3"), (k % 256).cast("string"))
    ip = F.when(k % 5 == 0, F.concat(F.lit("::ffff:"), ip)).otherwise(ip)
    return read(spark, sf_dir, "orders").select(k.alias("id"), urls.private_address(ip).alias("blocked"), urls.private_address(ip, strict=True).alias("blocked_strict"))


def known_addresses(host: str) -> list[str]:
    """A made-up resolver: what a name answers follows from its first letters."""
    return [[], ["10.0.0.9"], ["93.184.216.34", "8.8.8.8"], ["93.184.216.34", "::1"], ["fe80::2"], ["::ffff:93.184.216.34"], ["2606:2800:220::1"]][(len(host) + ord(host[0])) % 7]


@query(f"""SELECT page_id, CASE g WHEN 0 THEN 'Host could not be resolved: ' || h WHEN 2 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE '{addresses.PRIVATE}' END AS unsafe,
           CASE g WHEN 2 THEN '93.184.216.34' WHEN 5 THEN '::ffff:93.184.216.34' WHEN 6 THEN '2606:2800:220::1' END AS address
           FROM (SELECT page_id, h, (length(h) + ascii(h)) % 7 AS g FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM pages))""")
def address_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, looked up once by an injected resolver: why it may not be asked, or the address to connect to."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("target"))
    return addresses.Addresses(Work(spark, "addresses").save, known_addresses).gate(pages, 0).select("page_id", "unsafe", "address")


# --- robots -------------------------------------------------------------------


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file for each supplier; those of odd number also have a group for this agent."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    common = F.concat(F.lit("User-agent: other\nDisallow: /other\n\nUser-agent: *  # all\nDisallow: /p"), s, F.lit("/\nAllow: /p"), s, F.lit("/open*\nCrawl-delay: "), (k % 7).cast("string"), F.lit(".5\n"))
    own = F.concat(F.lit("USER-AGENT: LodeStone\r\nDisallow: /own"), s, F.lit("$\nCrawl-delay: x\nCrawl-delay: "), (k % 5).cast("string"), F.lit("\n"))
    body = F.when(k % 2 == 1, F.concat(common, own)).otherwise(common)
    status = F.when(k % 10 == 0, 503).when(k % 10 == 3, 404).otherwise(200)
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("https://s"), s, F.lit(".example")).alias("origin"), status.alias("status"), body.alias("body"))


@query("""SELECT 'https://s' || s_suppkey || '.example' AS origin, allow, path, CAST(length(replace(replace(path, '*', ''), '$', '')) AS INTEGER) AS specificity
          FROM (SELECT s_suppkey, false AS allow, '/p' || s_suppkey || '/' AS path FROM supplier WHERE s_suppkey % 2 = 0
                UNION ALL SELECT s_suppkey, true, '/p' || s_suppkey || '/open*' FROM supplier WHERE s_suppkey % 2 = 0
                UNION ALL SELECT s_suppkey, false, '/own' || s_suppkey || '$' FROM supplier WHERE s_suppkey % 2 = 1)""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.rules_of(robots_files(spark, sf_dir).select("origin", "body"), fx.AGENT).select("origin", "allow", "path", "specificity")


@query("SELECT 'https://s' || s_suppkey || '.example' AS origin, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 7 * 1000 + 500 ELSE s_suppkey % 5 * 1000 END AS BIGINT) AS delay_ms FROM supplier")
def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.delays_of(robots_files(spark, sf_dir).select("origin", "body"), fx.AGENT)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 = 0 THEN false WHEN l_suppkey % 10 = 3 THEN true WHEN l_suppkey % 2 = 0 THEN l_linenumber <> 1 ELSE l_linenumber <> 3 END AS allowed FROM lineitem""")
def robots_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a request to its supplier's site: policy join, then arg-max of the rules."""
    k, n = F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    path = F.when(n == 1, F.concat(F.lit("/p"), k, F.lit("/x"))).when(n == 2, F.concat(F.lit("/p"), k, F.lit("/open/y"))).when(n == 3, F.concat(F.lit("/own"), k)).when(n == 4, F.concat(F.lit("/own"), k, F.lit("/z"))).otherwise("/free")
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", n, F.concat(F.lit("https://s"), k, F.lit(".example"), path).alias("url"))
    p = robots.policies_of(robots_files(spark, sf_dir), fx.AGENT).withColumnRenamed("origin", "o")
    j = r.join(p, urls.origin(F.col("url")) == F.col("o"), "left")
    return j.select("l_orderkey", "l_linenumber", robots.allows(F.col("block_all"), F.col("rules"), urls.robots_target(F.col("url"))).alias("allowed"))


@query("""SELECT page_id, NOT (regexp_matches(t, '^/(en|fr)/[0-9]+\\?') OR (regexp_matches(t, '^/de/') AND NOT ends_with(t, '.html'))) AS allowed
          FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS t FROM pages)""")
def robots_decide_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy for all origins of the page table, decided for every page."""
    body = "User-agent: *\nDisallow: /en/*?\nDisallow: /fr/*?\nDisallow: /de/\nAllow: /de/*.html$\n"
    pages = read(spark, sf_dir, "pages").select("page_id", "url", urls.origin(F.col("url")).alias("origin"))
    p = robots.policies_of(pages.select("origin").distinct().select("origin", F.lit(200).alias("status"), F.lit(body).alias("body")), fx.AGENT)
    return pages.join(p, "origin").select("page_id", robots.allows(F.col("block_all"), F.col("rules"), urls.robots_target(F.col("url"))).alias("allowed"))


@query("""SELECT user_id AS origin, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events
          WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 900 SECOND) WHERE r = 1""")
def robots_cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached files: the latest fresh one of each origin."""
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("origin"), "event_id", F.struct("ts", "event_id").alias("at"), F.col("ts").alias("fetched_at"))
    top = ev.agg(F.max("fetched_at").alias("now"))
    rows = ev.join(F.broadcast(top))  # one row
    return robots.fresh(rows.drop("at"), F.col("now")).select("origin", "event_id")


# --- fetch, retry, rate -------------------------------------------------------


@query(f"""SELECT id, CASE WHEN error IS NOT NULL THEN CASE WHEN error IN ('blocked','unsafe') THEN 'SKIPPED' WHEN error IN ('io','retryable') THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END ELSE 'FAILED' END
            WHEN status IN (408,425,429) OR status >= 500 THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END WHEN status NOT BETWEEN 200 AND 299 THEN 'FAILED'
            WHEN contains(k, 'text/html') OR contains(k, 'application/xhtml+xml') THEN 'DONE' ELSE 'SKIPPED' END AS state,
          CASE WHEN error IS NULL THEN CASE WHEN status IN (408,425,429) OR status >= 500 OR status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status
            WHEN NOT (contains(k, 'text/html') OR contains(k, 'application/xhtml+xml')) THEN 'Unsupported content type: ' || k END END AS message
        FROM (SELECT *, lower(coalesce(content_type, 'application/octet-stream')) AS k FROM {spread_sql(fx.RESPONSES, 'orders', 'o_orderkey')})""")
def fetch_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = fetching.content_type(F.col("content_type"))
    by_error = fetching.error_state(F.col("error"), F.col("attempts"))
    state = F.when(F.col("error").isNotNull(), by_error).otherwise(fetching.outcome(F.col("status"), k, F.col("attempts")))
    message = F.when(F.col("error").isNull(), fetching.outcome_message(F.col("status"), k))
    return spread(spark, sf_dir, fx.RESPONSES, "orders", "o_orderkey").select("id", state.alias("state"), message.alias("message"))


@query(f"""SELECT id, CAST(least(60, greatest(ra, 2 * pow(2, greatest(0, attempts - 1)))) AS BIGINT) AS wait_s, ra AS retry_after_s
           FROM (SELECT id, attempts, greatest(0, coalesce(TRY_CAST(trim(retry_after) AS BIGINT), 0)) AS ra FROM {spread_sql(fx.RESPONSES, 'orders', 'o_orderkey')})""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra = scoring.retry_after(F.col("retry_after"))
    return spread(spark, sf_dir, fx.RESPONSES, "orders", "o_orderkey").select("id", scoring.backoff_seconds(F.col("attempts"), ra).alias("wait_s"), ra.alias("retry_after_s"))


@query("SELECT event_id, greatest(25, least(500, event_id * 37 % 1000 - 100)) AS wait_ms FROM events")
def retry_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a worker sleeps before it looks for due rows again."""
    return read(spark, sf_dir, "events").select("event_id", scoring.retry_wait_ms(F.col("event_id") * 37 % 1000 - 100).alias("wait_ms"))


_BITS = "(event_id >> {k}) % 2 = 1"


@query(f"""SELECT event_id, CASE WHEN {_BITS.format(k=0)} AND NOT {_BITS.format(k=2)} THEN 'Redirect left the careers site or supported ATS hosts'
           WHEN NOT {_BITS.format(k=0)} AND {_BITS.format(k=1)} AND NOT {_BITS.format(k=3)} THEN 'Redirect left the permitted host' WHEN NOT {_BITS.format(k=4)} THEN 'Blocked by robots.txt' END AS reason FROM events""")
def redirect_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the gate's conditions, by the bits of event ids."""
    bits = [F.shiftright("event_id", k) % 2 == 1 for k in range(5)]
    return read(spark, sf_dir, "events").select("event_id", fetching.block_reason(*bits).alias("reason"))


@query("SELECT c_custkey AS id, c_name || 'é' AS body FROM customer")
def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names, encoded in the charset that their header names."""
    text, k = F.concat("c_name", F.lit("é")), F.col("c_custkey") % 4
    raw = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, F.encode(text, "ISO-8859-1")).when(k == 2, F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8"))
    kind = F.when(k == 1, "text/html; charset=ISO-8859-1").when(k == 2, "text/html;charset=utf-16be").when(k == 3, 'text/html; charset="utf-8"')
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), web.decode_body(raw, kind).alias("body"))


LIMITER = "SELECT event_id, user_id, epoch_us(ts) AS t, greatest(CAST(floor(1000000 / greatest(0.1, (1 + event_id % 4) / 4000.0)) AS BIGINT), CAST(event_id % 7 AS BIGINT) * 1000000) AS step FROM events"


@query(f"""SELECT event_id, slot_us, slot_us - t AS wait_us FROM (SELECT *, s + max(t - s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS slot_us
           FROM (SELECT *, coalesce(sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({LIMITER})))""".replace("slot_us, slot_us - t AS wait_us", "CAST(slot_us AS BIGINT) AS slot_us, CAST(slot_us - t AS BIGINT) AS wait_us"))
def rate_limit_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = limiter_requests(read(spark, sf_dir, "events"))
    return schedule.slots(rows, "user_id", "t_us", "step_us", ["t_us", "event_id"]).select("event_id", "slot_us", "wait_us")


def limiter_requests(events: DataFrame) -> DataFrame:
    """Events as requests, with a rate and a robots delay made from their id."""
    rate = (1 + F.col("event_id") % 4) / 4000.0
    return events.select("event_id", "user_id", micros("ts").alias("t_us"), schedule.interval_us(rate, (F.col("event_id") % 7) * 1000).alias("step_us"))


@query(f"""SELECT event_id, CAST(slot_us AS BIGINT) AS slot_us FROM (SELECT *, s + max(t - s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS slot_us
           FROM (SELECT *, coalesce(sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({LIMITER})))""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.streaming import stateful

    rows = limiter_requests(read(spark, sf_dir, "events")).select(F.col("user_id").alias("origin"), F.col("event_id").alias("seq"), "t_us", "step_us")
    return stateful.replay(rows, stateful.quarter(rows, F.col("seq")), 4, stateful.limiter_slots).select(F.col("seq").alias("event_id"), "slot_us")


# --- frontier -----------------------------------------------------------------

STATES = "(CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RETRY' WHEN 'purchase' THEN 'FETCHING' WHEN 'signup' THEN 'DONE' ELSE 'FAILED' END)"
FRONTIER = f"(SELECT event_id AS id, user_id % 20 AS job_id, CAST(event_id % 5 AS INTEGER) AS depth, {STATES} AS status, CAST(event_id % 4 AS INTEGER) AS attempts, epoch_us(ts) AS due FROM events)"
AS_OF = "1704500000000000"


def frontier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frontier rows; due times in microseconds."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("job_id"), (F.col("event_id") % 5).cast("int").alias("depth"),
        F.expr(STATES).alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("next_attempt_at"),
    )


def as_of() -> Column:
    return F.timestamp_micros(F.lit(int(AS_OF)))


@query(f"SELECT id, job_id FROM {FRONTIER} WHERE status IN ('PENDING','RETRY') AND due <= {AS_OF}")
def frontier_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.ready(frontier_table(spark, sf_dir), as_of()).select("id", "job_id")


@query(f"SELECT id, job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY depth, id) AS INTEGER) AS claim FROM {FRONTIER} WHERE status IN ('PENDING','RETRY') AND due <= {AS_OF}")
def frontier_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.claim_order(frontier_table(spark, sf_dir), as_of()).select("id", "job_id", "claim")


@query(f"SELECT id, job_id, 'FETCHING' AS status, attempts + 1 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, id) AS r FROM {FRONTIER} WHERE status IN ('PENDING','RETRY') AND due <= {AS_OF}) WHERE r = 1")
def frontier_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.claim(frontier_table(spark, sf_dir), as_of()).select("id", "job_id", "status", "attempts")


@query(f"SELECT job_id, count(*) FILTER (WHERE status IN ('PENDING','RETRY','FETCHING')) AS outstanding, min(due) FILTER (WHERE status IN ('PENDING','RETRY')) AS next_us FROM {FRONTIER} GROUP BY job_id")
def frontier_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.outstanding(frontier_table(spark, sf_dir)).select("job_id", "outstanding", F.unix_micros("next_at").alias("next_us"))


@query(f"SELECT id, CASE WHEN status = 'FETCHING' THEN 'RETRY' ELSE status END AS status, attempts, CASE WHEN status = 'FETCHING' THEN {AS_OF} ELSE due END AS due_us FROM {FRONTIER}")
def frontier_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.requeue(frontier_table(spark, sf_dir), as_of()).select("id", "status", "attempts", F.unix_micros("next_attempt_at").alias("due_us"))


RESULTS_SQL = "SELECT event_id AS id, CAST(1 + event_id % 3 AS INTEGER) AS attempts, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 200 END AS st, CASE event_id % 6 WHEN 4 THEN 'image/png' ELSE 'text/html' END AS ct, CASE event_id % 6 WHEN 5 THEN 'io' END AS er, CAST(event_id % 90 AS VARCHAR) AS ra, epoch_us(ts) AS due FROM events"


@query(f"""SELECT id, state, CASE WHEN state = 'RETRY' THEN {AS_OF} + 1000000 * CAST(least(60, greatest(CASE WHEN er IS NULL THEN CAST(ra AS BIGINT) ELSE 0 END, 2 * pow(2, attempts - 1))) AS BIGINT) ELSE due END AS due_us,
             CASE WHEN er IS NOT NULL THEN er WHEN st IN (503, 429, 404) THEN 'HTTP ' || st WHEN ct = 'image/png' THEN 'Unsupported content type: image/png' END AS last_error
           FROM (SELECT *, CASE WHEN er IS NOT NULL OR st IN (503, 429) THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END WHEN st = 404 THEN 'FAILED' WHEN ct = 'image/png' THEN 'SKIPPED' ELSE 'DONE' END AS state FROM ({RESULTS_SQL}))""")
def frontier_after_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a frontier row with a fetch result."""
    k = F.col("event_id") % 6
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (1 + F.col("event_id") % 3).cast("int").alias("attempts"), F.lit("FETCHING").alias("status"), F.col("ts").cast("timestamp").alias("next_attempt_at"),
        F.when(k.isin(0, 4), 200).when(k == 1, 503).when(k == 2, 404).when(k == 3, 429).alias("http_status"), F.when(k == 4, "image/png").otherwise("text/html").alias("content_type"),
        F.when(k == 5, "io").alias("error"), (F.col("event_id") % 90).cast("string").alias("retry_after"),
    )
    out = fr.after_fetch(rows, as_of())
    return out.select("id", F.col("status").alias("state"), F.unix_micros("next_attempt_at").alias("due_us"), "last_error")


JOBS_SQL = "(SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PAUSED' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'CANCELLED' ELSE 'FAILED' END AS status FROM customer)"


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as crawl jobs."""
    k = F.col("c_custkey") % 6
    status = F.when(k == 0, "QUEUED").when(k == 1, "RUNNING").when(k == 2, "PAUSED").when(k == 3, "COMPLETED").when(k == 4, "CANCELLED").otherwise("FAILED")
    none = F.lit(None).cast("timestamp")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"), none.alias("started_at"), none.alias("completed_at"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"))


@query(f"""SELECT j.id, j.status, coalesce(p.n, 0) AS pages_crawled, coalesce(f.n, 0) AS pages_failed FROM {JOBS_SQL} j
           LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) p ON p.o_custkey = j.id
           LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = j.id""")
def count_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pages, and by their status for failed frontier rows."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("DONE").alias("status"))
    return fr.refreshed_counts(jobs_table(spark, sf_dir), orders, orders).select("id", "status", "pages_crawled", "pages_failed")


ACTIONS = {
    "run": (("QUEUED", "RUNNING", "PAUSED", "FAILED"), "RUNNING"), "pause": (("RUNNING", "QUEUED"), "PAUSED"), "resume": (("PAUSED", "FAILED"), "QUEUED"),
    "cancel": (("QUEUED", "RUNNING", "PAUSED", "FAILED"), "CANCELLED"), "complete": (("RUNNING",), "COMPLETED"), "fail": (("RUNNING", "QUEUED"), "FAILED"),
}


@query(" UNION ALL ".join(f"SELECT '{a}' AS action, id, CASE WHEN status IN {ok} THEN '{to}' ELSE status END AS status, status IN {ok} AND '{to}' IN ('COMPLETED','CANCELLED','FAILED') AS ended FROM {JOBS_SQL}".replace(",)", ")") for a, (ok, to) in ACTIONS.items()))
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, out = jobs_table(spark, sf_dir), None
    for a in ACTIONS:
        rows = fr.job_after(jobs, a, as_of()).select(F.lit(a).alias("action"), "id", "status", F.col("completed_at").isNotNull().alias("ended"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT id, status FROM {JOBS_SQL} WHERE status IN ('QUEUED','RUNNING') AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def recovery_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumable jobs without an active worker."""
    active = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("job_id"))
    return fr.launchable(jobs_table(spark, sf_dir), active).select("id", "status")


MOVES = {"view": "FETCHING", "click": "DONE", "purchase": "RETRY", "signup": "FETCHING", "error": "FAILED"}


@query("SELECT user_id AS key, max_by(event_type, event_id) AS last_type, max(event_id) AS seq FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return tables.latest(ev, ["user_id"], ["event_id"]).select(F.col("user_id").alias("key"), F.col("event_type").alias("last_type"), F.col("event_id").alias("seq"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
              CASE event_type WHEN 'view' THEN 'FETCHING' WHEN 'click' THEN 'DONE' WHEN 'purchase' THEN 'RETRY' WHEN 'signup' THEN 'FETCHING' ELSE 'FAILED' END AS mv FROM events),
            s AS (SELECT key, CAST(0 AS BIGINT) AS r, 'PENDING' AS st, 0 AS att, 0 AS ref FROM (SELECT DISTINCT key FROM e)
              UNION ALL SELECT s.key, e.r, CASE WHEN ok THEN mv ELSE st END, att + CASE WHEN ok AND mv = 'FETCHING' THEN 1 ELSE 0 END, ref + CASE WHEN ok THEN 0 ELSE 1 END
              FROM s JOIN e ON e.key = s.key AND e.r = s.r + 1,
              LATERAL (SELECT (st IN ('PENDING','RETRY') AND mv = 'FETCHING') OR (st = 'FETCHING' AND mv <> 'FETCHING') AS ok))
          SELECT key, max_by(st, r) AS status, max_by(att, r) AS attempts, max_by(ref, r) AS refused FROM s GROUP BY key""")
def stream_frontier_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over events as a stream; last state of every key."""
    from lodestone.streaming import stateful

    to = F.create_map(*(F.lit(x) for p in MOVES.items() for x in p))[F.col("event_type")]
    moves = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), to.alias("to"))
    out = stateful.replay(moves, stateful.quarter(moves, F.col("seq")), 4, stateful.frontier_states, "update")
    return tables.latest(out, ["key"], ["batch", "seq"]).select("key", "status", "attempts", "refused")


_PARTS = "SELECT *, CASE WHEN event_id % 50 = 0 THEN 3 ELSE floor(4.0 * (t - lo) / (hi - lo + 1)) END AS part FROM (SELECT *, epoch_us(ts) AS t, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events)"


@query(f"""WITH p AS ({_PARTS}), w AS (SELECT k.part, max(floor(q.t / 1000)) * 1000 - 600000000 AS mark FROM (SELECT DISTINCT part FROM p) k JOIN p q ON q.part < k.part GROUP BY k.part)
           SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n FROM p LEFT JOIN w USING (part)
           WHERE mark IS NULL OR epoch_us(date_trunc('hour', ts)) + 3600000000 > mark GROUP BY 1, 2""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events that come in four parts, every fiftieth with the last: what is behind the watermark then is left out."""
    from lodestone.streaming import stateful

    ev = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    part = F.when(F.col("event_id") % 50 == 0, 3).otherwise(stateful.quarter(ev, F.unix_micros("ts")))
    counts = lambda e: stateful.windowed_counts(e, "ts", "event_type").select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n")
    return tables.latest(stateful.replay(ev, part, 4, counts, "update"), ["hour_us", "event_type"], ["batch"]).select("hour_us", "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set insert on a stream: every key once."""
    from lodestone.streaming import stateful

    ev = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    first = lambda e: stateful.first_seen(e, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    return stateful.replay(ev, stateful.quarter(ev, F.unix_micros("ts")), 4, first).select("user_id", "event_type")


# --- graph, joins, keys -------------------------------------------------------

GRAPH = f"SELECT 'p' || page_id AS src, 't' || href AS dst FROM (SELECT page_id, unnest(list_distinct({HREFS})) AS href FROM pages)"


def token_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the link tokens they share, both ways."""
    e = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.explode(F.array_distinct(html.hrefs(F.col("html")))).alias("h"))
    e = e.select("src", F.concat(F.lit("t"), F.col("h")).alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


BFS_SQL = f"""WITH RECURSIVE g AS ({GRAPH}), e AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g),
    b AS (SELECT 'p0' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4)"""


@query(f"{BFS_SQL} SELECT node, min(depth) AS depth FROM b GROUP BY node")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfs.levels(token_graph(spark, sf_dir), spark.createDataFrame([("p0",)], "node string"), 4)


@query(f"{BFS_SQL} SELECT node, depth FROM (SELECT node, min(depth) AS depth FROM b GROUP BY node) ORDER BY depth, node LIMIT 50")
def bfs_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page budget cuts the ranking; the limit is the feature."""
    return bfs.levels(token_graph(spark, sf_dir), spark.createDataFrame([("p0",)], "node string"), 4, budget=50)


@query("""SELECT o_custkey AS job_id, o_orderkey AS rank FROM (SELECT *, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 3""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("rank"), (F.col("o_orderstatus") == "F").alias("saved"))
    return fr.within_budget(rows, "saved", 0, 3).select("job_id", "rank")


@query("""SELECT s.s_suppkey AS job_id, n.n_name AS root, coalesce(c.n, 0) AS postings FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
          LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON c.l_suppkey = s.s_suppkey""")
def scan_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans joined to their jobs, with posting counts (suppliers, nations, items)."""
    counts = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("job_id"), F.col("n_name").alias("root"), F.coalesce("n", F.lit(0)).alias("postings"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def career_scan_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: jobs that are scans."""
    big = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return tables.orphans(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) x
          WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_returnflag = 'N' AND y.l_partkey = x.l_partkey AND y.l_suppkey = x.l_suppkey)""")
def set_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first insert on a unique key, less the keys that are there."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return tables.set_insert(li.where("l_returnflag = 'N'"), li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).drop("l_returnflag")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AND user_id >= 10 AS inserted FROM events")
def insert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return tables.insert_report(ev.where("user_id < 10"), ev, ["user_id", "event_type"], ["event_id"]).select("event_id", "inserted")


# --- skills, matching, postings -----------------------------------------------


def skills_sql(entries, source: str, text: str = "text") -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({text}, '')), {fx.literal(skills.re2_pattern(p))}) THEN {fx.literal(n)} END" for n, p in entries)
    return f"array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT id, {skills_sql(skills.CATALOG, '')} AS skills FROM {spread_sql(fx.TEXTS, 'customer', 'c_custkey', 'text')}")
def skill_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, fx.TEXTS, "customer", "c_custkey", "text").select("id", F.array_join(skills.detect(F.col("text")), ",").alias("skills"))


# Words of the corpus, so that the operator has work on the document table.
CORPUS_CATALOG = (("The", "the"), ("Der", "der|die|das"), ("License", "licen[sc]ed?"), ("Les", r"\bles\b"), ("Idiot", "idiot|moron"), ("Table", r"\|"), ("Rights", "all rights reserved"), ("Mail", "@"))


@query(f"SELECT doc_id, {skills_sql(CORPUS_CATALOG, '')} AS skills FROM documents")
def skill_detect_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(skills.detect(F.col("text"), CORPUS_CATALOG), ",").alias("skills"))


RESUME = "Experienced Java and Spring Boot engineer using Kafka and SQL in distributed systems, with some years of work on data platforms."
RESUME_SKILLS = ["Java", "SQL", "Spring Boot", "Kafka", "Distributed Systems"]
_OVERLAP = f"list_filter(skills, lambda s: list_contains({fx.literal(RESUME_SKILLS)}, s))"
_GAP = f"list_filter(skills, lambda s: NOT list_contains({fx.literal(RESUME_SKILLS)}, s))"


@query(f"""SELECT id, CAST(CASE WHEN len(skills) = 0 THEN 35 ELSE floor(20 + 80.0 * len({_OVERLAP}) / len(skills) + 0.5) END AS INTEGER) AS score, array_to_string({_OVERLAP}, ',') AS matched, array_to_string({_GAP}, ',') AS missing,
           CASE WHEN len(skills) = 0 THEN 'The posting did not expose enough recognized skills for a high-confidence score.' ELSE len({_OVERLAP}) || ' of ' || len(skills) || ' recognized job skills appear in the resume.' END AS summary FROM {PART_JOBS}""")
def skill_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match(part_jobs(spark, sf_dir), RESUME).matches
    return m.select("id", "score", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "summary")


_PHRASE = "(p_size % 9 + 1) || CASE p_size % 3 WHEN 0 THEN '+ years' WHEN 1 THEN ' to 12 years' ELSE ' YEARS' END || CASE p_size % 2 WHEN 0 THEN ' of' ELSE '' END || ' data-pipeline work experience'"


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {_PHRASE} END AS experience FROM part")
def experience_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"CASE WHEN p_partkey % 5 = 0 THEN 'Many years of experience' ELSE p_name || ', needs ' || {_PHRASE} || '. 9 years of experience' END")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scoring.experience(text).alias("experience"))


@query(f"SELECT id, regexp_matches(lower(coalesce(title, '')), '\\b({'|'.join(scoring.ROLE_WORDS)})\\b') AS is_role FROM {spread_sql(fx.TITLES, 'part', 'p_partkey', 'title')}")
def role_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, fx.TITLES, "part", "p_partkey", "title").select("id", scoring.is_role_title(F.col("title")).alias("is_role"))


_FILLER = "A small crew looks after many machines here, reads every alarm with care, writes down what was learned, and leaves each place tidier than it was found."


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'Data Engineer ' || p_partkey END AS title, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE 'firm.example' END AS company,
          CASE p_partkey % 3 WHEN 0 THEN p_type || ', ' || p_size || '; Remote' ELSE 'Hall ' || p_size END AS location, CASE p_partkey % 3 WHEN 0 THEN 'Kafka,Linux' ELSE 'SQL' END AS skills,
          CASE p_partkey % 3 WHEN 0 THEN p_size || ' years of testing experience' ELSE 'Not specified' END AS experience, CASE p_partkey % 3 WHEN 0 THEN 'FULL_TIME, ' || p_size ELSE '' END AS employment_type,
          CASE p_partkey % 3 WHEN 0 THEN 'JSON_LD' ELSE 'HEURISTIC' END AS extraction_method FROM part WHERE p_partkey % 3 < 2""")
def posting_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured, heuristic and other pages made of parts; selectors and types in mixed case."""
    ld = F.to_json(F.struct(
        F.lit("jobposting").alias("@type"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), F.lit("telecommute").alias("jobLocationType"),
        F.struct(F.struct(F.col("p_type").alias("addressLocality"), F.col("p_size").alias("addressCountry")).alias("address")).alias("jobLocation"), F.array(F.lit("FULL_TIME"), F.col("p_size").cast("string")).alias("employmentType"),
        F.concat(F.lit("&lt;p&gt;Linux and Kafka, "), F.col("p_size").cast("string"), F.lit(" years of testing experience&lt;/p&gt;")).alias("description"),
    ))
    k = F.col("p_partkey")
    structured = F.concat(F.lit('<html><head><script type=" Application/LD+JSON ">'), ld, F.lit("</script></head><body><h1>x</h1></body></html>"))
    plain = F.concat(F.lit("<html><body><h1>Data Engineer "), k.cast("string"), F.lit('</h1><div class="the-Job-Location">Hall '), F.col("p_size").cast("string"), F.lit(f"</div><main>{_FILLER} SQL</main></body></html>"))
    parts = tables.dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    pages = parts.select(k.alias("id"), F.when(k % 3 == 2, "https://firm.example/about").otherwise(F.concat(F.lit("https://www.firm.example/jobs/"), k.cast("string"))).alias("url"), F.when(k % 3 == 0, structured).otherwise(plain).alias("html"))
    p = postings.posted(pages, "id")
    return p.select("id", "p.title", "p.company", "p.location", F.array_join(F.array_sort("p.skills"), ",").alias("skills"), "p.experience", "p.employment_type", "p.extraction_method")


@query(f"SELECT id, array_to_string(skills, ',') AS back, to_json(skills) AS stored FROM {PART_JOBS}")
def skills_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = skills.to_json_list(F.col("skills"))
    return part_jobs(spark, sf_dir).select("id", F.array_join(skills.from_json_list(stored), ",").alias("back"), stored.alias("stored"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 3 THEN 2 ELSE 0 END AS n FROM orders")
def skills_codec_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lists that are missing, no JSON, empty, right, or cut off."""
    k = F.col("o_orderkey")
    stored = F.when(k % 5 == 1, "nope").when(k % 5 == 2, "[]").when(k % 5 == 3, F.concat(F.lit('["a","'), k.cast("string"), F.lit('"]'))).when(k % 5 == 4, '["a",')
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.size(skills.from_json_list(stored)).alias("n"))


# --- exports, lists, external matcher -----------------------------------------


def _csv_sql(c: str) -> str:
    return f"""'"' || replace(replace(replace(coalesce({c}, ''), '"', '""'), chr(13), ' '), chr(10), ' ') || '"'"""


@query("SELECT id, " + " || ',' || ".join(_csv_sql("array_to_string(skills, ' | ')" if c == "skills" else c) for c in export.CSV_COLUMNS) + f" AS line FROM {PART_JOBS}")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_rows(part_jobs(spark, sf_dir))


@query(f"SELECT 'jobs.json' AS filename, 'application/json' AS mime, title, company, location, array_to_string(skills, ',') AS skills, source_url AS \"sourceUrl\" FROM {PART_JOBS}")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported array, parsed back (white space differs between engines)."""
    out = export.json_document(part_jobs(spark, sf_dir)).select("filename", "mime", F.decode("payload", "UTF-8").alias("payload"))
    kind = "array<struct<title: string, company: string, location: string, skills: array<string>, sourceUrl: string>>"
    rows = out.select("filename", "mime", F.explode(F.from_json("payload", kind)).alias("r"))
    return rows.select("filename", "mime", "r.title", "r.company", "r.location", F.array_join("r.skills", ",").alias("skills"), "r.sourceUrl")


@query(f"SELECT CAST(row_number() OVER (ORDER BY discovered_at, title, id) AS INTEGER) AS pos, id FROM {PART_JOBS}")
def posting_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings in listing order, numbered."""
    rows, _ = crawl.numbered(Work(spark, "listing"), part_jobs(spark, sf_dir), ["discovered_at", "title", "id"], 1, "rows")
    return rows.select(F.col("number").cast("int").alias("pos"), "id")


@query(f"""SELECT 'job-' || p_partkey AS id, p_name AS title, CAST(greatest(0, least(100, p_size * 7 - 50)) AS INTEGER) AS score, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Java' END AS matched, p_brand AS missing,
           CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'fits ' || p_size END AS summary FROM part""")
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every posting, one of a posting that nobody knows, and missing fields."""
    k = F.col("p_partkey")
    found = F.struct(
        F.concat(F.lit("job-"), k.cast("string")).alias("jobId"), (F.col("p_size") * 7 - 50).cast("int").alias("score"), F.when(k % 4 != 0, F.array(F.lit("Java"))).alias("matchedSkills"),
        F.array("p_brand").alias("missingSkills"), F.when(k % 5 != 0, F.concat(F.lit("fits "), F.col("p_size").cast("string"))).alias("summary"),
    )
    stranger = F.struct(F.lit("nobody").alias("jobId"), F.lit(50).alias("score"), F.array(F.lit("x")).alias("matchedSkills"), F.array(F.lit("x")).alias("missingSkills"), F.lit("x").alias("summary"))
    answers = read(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(found, stranger).alias("matches"))).alias("text"))
    out = matching.parsed_answer(answers, part_jobs(spark, sf_dir))
    return out.select("id", "title", "score", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "summary")


@query(f"""SELECT id AS "jobId", title, CAST(CASE WHEN len(skills) = 0 THEN 35 ELSE floor(20 + 80.0 * len({_OVERLAP}) / len(skills) + 0.5) END AS INTEGER) AS "baselineScore" FROM {PART_JOBS} ORDER BY discovered_at, title, id LIMIT 15""")
def llm_payload_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen jobs of the listing; the limit is the feature."""
    return matching.prompt_rows(part_jobs(spark, sf_dir), RESUME).select("jobId", "title", "baselineScore")


@query("""SELECT k AS id, CASE WHEN k % 11 = 0 THEN 'http://10.0.0.5/' ELSE 'http://tree.example/' END || CASE WHEN k % 7 = 0 THEN 'gone-' ELSE '' END || k AS url, CAST(CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 404 WHEN k % 3 = 0 THEN 503 ELSE 200 END AS INTEGER) AS status,
          CASE WHEN k % 11 = 0 THEN 'unsafe' END AS error, CAST(1 AS BIGINT) AS times FROM (SELECT c_custkey AS k FROM customer)""")
def stream_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every customer's page that come in four parts, every fifth again in the next one; the stream starts again for each."""
    from lodestone.streaming import fetching as fetches
    from lodestone.streaming import stateful

    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k, F.concat(F.when(k % 11 == 0, "http://10.0.0.5/").otherwise("http://tree.example/"), F.when(k % 7 == 0, "gone-").otherwise(""), k.cast("string")).alias("url"), F.lit(1).alias("attempt"))
    rows = rows.withColumn("part", stateful.quarter(rows, k))
    rows = rows.unionByName(rows.where("c_custkey % 5 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(3))))
    work, site = Work(spark, "requests"), tree_web(spark, sf_dir, flaky=3)
    for part in range(4):
        work.append(rows.where(F.col("part") == part).select("url", "attempt"), "in")
        fetches.fetch_stream(spark, f"{work.root}/in", f"{work.root}/out", f"{work.root}/checkpoint", site, fx.lookup).awaitTermination()
    got = fetches.fetched(spark, f"{work.root}/out")
    return got.groupBy(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("id"), "url", "status", "error").agg(F.count("*").alias("times"))


# --- many résumés, whole documents --------------------------------------------

OWN_SKILLS = (*JOB_SKILLS, "Python", "Docker")
PEOPLE = f"""(SELECT c_custkey AS id, list_filter([{', '.join(f"CASE WHEN c_custkey // {k + 1} % 3 = 0 THEN {fx.literal(n)} END" for k, n in enumerate(OWN_SKILLS))}], lambda x: x IS NOT NULL) AS own FROM customer)"""
PEOPLE_JOBS = f"""(SELECT p.id AS resume_id, j.id AS job_id, CAST(len(list_filter(skills, lambda s: list_contains(own, s))) AS INTEGER) AS matched, CAST(len(skills) AS INTEGER) AS wanted, discovered_at, title,
    CAST(CASE WHEN wanted = 0 THEN 35 ELSE floor(20 + 80.0 * matched / wanted + 0.5) END AS INTEGER) AS score FROM {PEOPLE} p, {PART_JOBS} j)"""
BEST = f"(SELECT *, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, discovered_at, title, job_id) AS INTEGER) AS rank FROM {PEOPLE_JOBS})"


def customer_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A résumé for every customer, naming some skills."""
    k = F.col("c_custkey")
    own = F.array_compact(F.array(*(F.when(F.floor(k / (i + 1)) % 3 == 0, n) for i, n in enumerate(OWN_SKILLS))))
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("Number "), k.cast("string"), F.lit(" knows: "), F.array_join(own, ", "), F.lit(".")).alias("text"))


@query(f"SELECT resume_id, rank, job_id, score, matched, wanted FROM {BEST} WHERE rank <= 10")
def match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best postings of every résumé; the ten are the feature."""
    people = customer_resumes(spark, sf_dir).select("id", skills.detect(F.col("text")).alias("skills"))
    return bulk_matching.best_matches(people, part_jobs(spark, sf_dir))


def odd_matcher(body: dict) -> str:
    """Stands for the outside matcher: fails for every fifth résumé, answers nothing to the next, else seven points above the overlap."""
    told = json.loads(body["input"].split("\n", 1)[1])
    number = int(re.search(r"\d+", told["resume"])[0])
    if number % 5 == 0:
        raise ConnectionError("no route")
    if number % 5 == 1:
        return json.dumps({"output": []})
    fits = [{"jobId": j["jobId"], "score": j["baselineScore"] + 7, "matchedSkills": j["skills"], "missingSkills": None, "summary": f"fits {number}"} for j in [*told["jobs"], {"jobId": "nobody", "baselineScore": 99, "skills": []}]]
    return json.dumps({"output": [{"content": [{"type": "output_text", "text": json.dumps({"matches": fits})}]}]})


@query(f"""WITH told AS (SELECT id FROM {PART_JOBS} ORDER BY discovered_at, title, id LIMIT 15),
           judged AS (SELECT *, least(100, score + 7) AS said FROM {PEOPLE_JOBS} WHERE resume_id % 5 > 1 AND job_id IN (SELECT id FROM told))
           SELECT resume_id, 'OPENAI:odd' AS method, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY said DESC, discovered_at, title, job_id) AS INTEGER) AS rank, job_id, said AS score, wanted AS matched, CAST(0 AS INTEGER) AS missing, 'fits ' || resume_id AS summary FROM judged
           UNION ALL SELECT resume_id, 'DETERMINISTIC', rank, job_id, score, matched, wanted - matched,
           CASE WHEN wanted = 0 THEN 'The posting did not expose enough recognized skills for a high-confidence score.' ELSE matched || ' of ' || wanted || ' recognized job skills appear in the resume.' END FROM {BEST} WHERE resume_id % 5 <= 1 AND rank <= 15""")
def match_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every résumé judged by an outside matcher that sometimes fails; fifteen postings a request are the feature."""
    return bulk_matching.match_each(customer_resumes(spark, sf_dir), part_jobs(spark, sf_dir), odd_matcher, "odd", pause=0.0)


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting for every order, with quotes and line breaks, many of one instant."""
    k, none = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit("scan").alias("scan_id"), F.lit("page").alias("page_id"), F.concat(F.lit("http://jobs.example/"), k).alias("source_url"), F.concat("o_orderpriority", F.lit(' "'), "o_orderstatus", F.lit('"')).alias("title"),
        none.alias("company"), F.lit("Hall\r\n7").alias("location"), F.array(F.lit("SQL"), F.col("o_orderstatus")).alias("skills"), F.lit("").alias("experience"), none.alias("employment_type"), none.alias("description"),
        F.lit("JSON_LD").alias("extraction_method"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"),
    )


_ORDER_TITLE = """o_orderpriority || ' "' || o_orderstatus || '"'"""
_ORDER_AT = f"row_number() OVER (ORDER BY CAST(o_orderdate AS TIMESTAMP), {_ORDER_TITLE}, CAST(o_orderkey AS VARCHAR))"
_ORDER_LINE = f"""concat_ws(',', '"' || replace({_ORDER_TITLE}, '"', '""') || '"', '""', '"Hall  7"', '"SQL | ' || o_orderstatus || '"', '""', '""', '"http://jobs.example/' || o_orderkey || '"', '"JSON_LD"')"""


@query(f"""SELECT 'csv' AS kind, {_ORDER_AT} + 1 AS pos, {_ORDER_LINE} AS line FROM orders UNION ALL SELECT 'csv', 1, {fx.literal(export.CSV_HEADER)}
           UNION ALL SELECT 'json', {_ORDER_AT}, o_orderkey || ' ' || {_ORDER_TITLE} FROM orders""")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as one document over several files and read again in its order."""
    work, jobs = Work(spark, "export"), order_postings(spark, sf_dir)
    for kind in ("csv", "json"):
        documents.write_document(jobs, f"{work.root}/{kind}", kind, rows_a_part=4_000)
    sheet = documents.document_lines(spark, f"{work.root}/csv")
    lines = documents.document_lines(spark, f"{work.root}/json")
    item = F.from_json(F.regexp_replace("line", r"^[\[,]|\]$", ""), "id string, title string")  # a line is an item, its comma, and the array's ends
    return sheet.select(F.lit("csv").alias("kind"), F.col("number").alias("pos"), "line").unionByName(lines.select(F.lit("json").alias("kind"), F.col("number").alias("pos"), F.concat_ws(" ", item["id"], item["title"]).alias("line")))


# --- whole crawls -------------------------------------------------------------


def tree_web(spark: SparkSession, sf_dir: str, robots_file: str | None = None, flaky: int = 0) -> DataFrame:
    """Every customer as a page of one site; page k links to pages 2k and 2k + 1.

    With ``flaky``, pages whose number it divides fail on the first attempt.
    """
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    s = lambda n: n.cast("string")
    link = lambda n: F.concat(F.lit('<a href="/'), s(n), F.lit('">x</a>'))
    body = F.concat(F.lit("<title>Page "), s(k), F.lit("</title>"), link(2 * k), link(2 * k + 1))
    rows = read(spark, sf_dir, "customer")
    answer = lambda status, kind, text, attempt: (F.concat(F.lit("http://tree.example/"), s(k)).alias("url"), attempt.cast("int").alias("attempt"), F.lit(status).alias("status"), F.lit(kind).alias("content_type"), text.alias("body"), none.alias("location"), none.alias("retry_after"), none.alias("error"))
    out = rows.select(*answer(200, "text/html", body, F.lit(None)))
    if flaky:
        out = out.unionByName(rows.where(k % flaky == 0).select(*answer(503, "text/plain", F.lit("busy"), F.lit(1))))
    if robots_file is not None:
        out = out.unionByName(spark.createDataFrame([("http://tree.example/robots.txt", None, 200, "text/plain", robots_file, None, None, None)], web.WEB))
    return out


TREE = "(SELECT c_custkey AS k, 'http://tree.example/' || c_custkey AS url, CAST(floor(log2(c_custkey)) AS INTEGER) AS depth FROM customer WHERE c_custkey > 0)"
TREE_SEED = "http://tree.example/1"


@query(f"SELECT url, depth, 'Page ' || k AS title, CAST(2 AS INTEGER) AS outbound_links FROM {TREE} WHERE depth <= 2")
def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a crawl; its depth bound is the feature."""
    out = crawl.crawl(spark, CrawlSpec(TREE_SEED, max_pages=500, max_depth=2, respect_robots=False), tree_web(spark, sf_dir))
    return out.pages.select("url", "depth", "title", "outbound_links")


@query(f"""SELECT CASE WHEN k >= 14 THEN k - 2 ELSE k END AS id, url, depth, CASE WHEN k = 6 THEN 'SKIPPED' ELSE 'DONE' END AS status, CAST(1 AS INTEGER) AS attempts, CASE WHEN k = 6 THEN 'Blocked by robots.txt' END AS last_error
           FROM {TREE} WHERE depth <= 3 AND k NOT IN (12, 13)""")
def crawl_site_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier of a crawl that loads the site's robots file: page 6 is not asked for, its links are unknown."""
    out = crawl.crawl(spark, CrawlSpec(TREE_SEED, max_pages=500, max_depth=3), tree_web(spark, sf_dir, "User-agent: *\nDisallow: /6$\n"))
    return out.frontier.select("id", F.col("canonical_url").alias("url"), "depth", "status", "attempts", "last_error")


@query(f"SELECT url, 'DONE' AS status, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM {TREE} WHERE depth <= 2")
def crawl_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crawl.crawl(spark, CrawlSpec(TREE_SEED, max_pages=500, max_depth=2, respect_robots=False), tree_web(spark, sf_dir, flaky=3))
    return out.frontier.select(F.col("canonical_url").alias("url"), "status", "attempts")


@query(f"SELECT k AS id, url, (k - 1) * 750000 AS slot_us FROM {TREE} WHERE depth <= 2")
def crawl_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page was asked for: the robots delay of 0.75 s outweighs the two requests a second."""
    out = crawl.crawl(spark, CrawlSpec(TREE_SEED, max_pages=500, max_depth=2, requests_per_second=2.0), tree_web(spark, sf_dir, "User-agent: *\nCrawl-delay: 0.75\n"))
    return out.frontier.select("id", F.col("canonical_url").alias("url"), (F.unix_micros("updated_at") - crawl.micros(crawl.START)).alias("slot_us"))


@query(f"""SELECT 'first' AS crawl, k AS id, (k - 1) * 500000 AS slot_us FROM {TREE} WHERE depth <= 2
           UNION ALL SELECT 'second', k, (k - 1 + (SELECT count(*) FROM {TREE} WHERE depth <= 2)) * 500000 FROM {TREE} WHERE depth <= 1""")
def crawl_shared_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls of one site, started at the same time: the second's requests come after the slots that the first has reserved."""
    root, site = Work(spark, "shared").root, tree_web(spark, sf_dir)
    of = lambda depth: crawl.crawl(spark, CrawlSpec(TREE_SEED, max_pages=500, max_depth=depth, requests_per_second=2.0, respect_robots=False), site, shared=root).frontier
    slots = lambda name, rows: rows.select(F.lit(name).alias("crawl"), "id", (F.unix_micros("updated_at") - crawl.micros(crawl.START)).alias("slot_us"))
    return slots("first", of(2)).unionByName(slots("second", of(1)))


class PausedAfter(crawl.Keeper):
    """Pauses a crawl after some rounds."""

    def __init__(self, rounds: int):
        self.left = rounds

    def status(self) -> str:
        self.left -= 1
        return "RUNNING" if self.left >= 0 else "PAUSED"


@query(f"SELECT k AS id, url, depth, 'DONE' AS status, (k - 1) * 500000 AS slot_us FROM {TREE} WHERE depth <= 2")
def crawl_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl paused after its first round and gone on with: the same frontier and slots as without the pause."""
    spec = CrawlSpec(TREE_SEED, max_pages=500, max_depth=2, requests_per_second=2.0, respect_robots=False)
    site = tree_web(spark, sf_dir)
    first = crawl.crawl(spark, spec, site, keeper=PausedAfter(1))
    out = crawl.crawl(spark, spec, site, frontier=first.frontier, saved=first.pages, limiter=first.limiter, started=first.clock)
    return out.frontier.select("id", F.col("canonical_url").alias("url"), "depth", "status", (F.unix_micros("updated_at") - crawl.micros(crawl.START)).alias("slot_us"))


@query(f"SELECT url, depth, 'DONE' AS status, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, 'COMPLETED' AS job, CAST(3 AS INTEGER) AS pages_crawled FROM {TREE} WHERE depth <= 1")
def frontier_update_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored frontier rows after a service's crawl: claims, retries and results replace earlier versions."""
    from datetime import datetime

    from lodestone.plans.service import Service

    service = Service(spark, Work(spark, "store").root, clock=lambda: datetime(2024, 1, 1), lookup=fx.lookup)
    job = service.create(CrawlSpec(TREE_SEED, max_pages=500, max_depth=1, respect_robots=False))
    service.run(job, tree_web(spark, sf_dir, flaky=2))
    state = service.get(job).select(F.col("id").alias("job_id"), F.col("status").alias("job"), "pages_crawled")
    return service.frontier(job).join(state, "job_id").select(F.col("canonical_url").alias("url"), "depth", "status", "attempts", "job", "pages_crawled")


def careers_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A careers site with a posting for each nation."""
    k, none = F.col("n_nationkey").cast("string"), F.lit(None).cast("string")
    ld = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(F.lit("Engineer for "), "n_name").alias("title"), F.lit("Kafka and Java").alias("description"),
        F.struct(F.struct(F.col("n_name").alias("addressLocality"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("addressRegion")).alias("address")).alias("jobLocation"),
    ))
    page = lambda url, text: (url.alias("url"), F.lit(None).cast("int").alias("attempt"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), text.alias("body"), none.alias("location"), none.alias("retry_after"), none.alias("error"))
    nations = read(spark, sf_dir, "nation")
    jobs = nations.select(*page(F.concat(F.lit("http://firm.example/careers/job/"), k), F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))))
    links = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="/careers/job/'), k, F.lit('">Open</a>')))), "")  # 25 nations
    home = nations.agg(F.concat(links, F.lit('<a href="/products/lamp">Lamp</a>')).alias("links")).select(*page(F.lit("http://firm.example/careers"), F.col("links")))
    return home.unionByName(jobs)


CAREERS = CareerSpec("http://firm.example/careers", max_pages=50, max_depth=1)


@query("SELECT 'http://firm.example/careers/job/' || n_nationkey AS source_url, 'Engineer for ' || n_name AS title, n_name || ', R' || n_regionkey AS location, 'Java,Kafka' AS skills, 'JSON_LD' AS extraction_method FROM nation")
def career_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that a scan of the careers site finds."""
    out = crawl.crawl(spark, CAREERS, careers_web(spark, sf_dir)).postings
    return out.select("source_url", "title", "location", F.array_join("skills", ",").alias("skills"), "extraction_method")


@query("""SELECT 'http://firm.example/careers' AS careers_url, 'COMPLETED' AS status, count(*) AS postings, CAST(count(*) + 1 AS INTEGER) AS pages_crawled, CAST(0 AS INTEGER) AS pages_failed,
          'jobs.csv' AS filename, 'text/csv' AS mime, CAST(count(*) + 1 AS INTEGER) AS lines, count(*) AS listed FROM nation""")
def service_career_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored scan from creation to its row in the listing, its postings and its download."""
    from datetime import datetime

    from lodestone.plans.service import Service

    service = Service(spark, Work(spark, "store").root, clock=lambda: datetime(2024, 1, 1), lookup=fx.lookup)
    job = service.create(CAREERS)
    service.run(job, careers_web(spark, sf_dir))
    lines = F.size(F.split(F.rtrim(F.decode("payload", "UTF-8"), F.lit("\r\n")), "\r\n"))
    sheet = service.download(job, "csv").select("filename", "mime", lines.alias("lines"))
    listed = service.postings(job).agg(F.count("*").alias("listed"))
    return service.scan(job).select("careers_url", "status", "postings", "pages_crawled", "pages_failed").join(F.broadcast(sheet)).join(F.broadcast(listed))  # one row each
