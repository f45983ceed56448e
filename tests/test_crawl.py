"""Redirects, budgets, limits and failures of whole crawls on the small site."""

import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone import fixtures as fx
from lodestone.operators import addresses
from lodestone.plans import crawl as crawls
from lodestone.plans.crawl import crawl
from lodestone.plans.spec import CareerSpec, CrawlSpec
from lodestone.plans.work import Work
from lodestone.sources import web


def run(spark, path, **more):
    spec = CrawlSpec(f"http://site.example{path}", **more)
    return crawl(spark, spec, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark))


def test_site(spark):
    out = run(spark, "/", max_pages=10, max_depth=2)
    assert sorted(map(tuple, out.pages.select("url", "depth", "title", "outbound_links").collect())) == sorted(fx.SITE_PAGES.rows)
    rows = out.frontier.select("id", "canonical_url", "depth", "status", "attempts", "last_error").collect()
    assert sorted(map(tuple, rows)) == sorted(fx.SITE_FRONTIER.rows)


def test_careers(spark):
    out = crawl(spark, CareerSpec("http://site.example/careers", max_pages=10, max_depth=2), fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark)).postings
    rows = out.select("source_url", "title", "location", F.array_join("skills", ","), "extraction_method").collect()
    assert list(map(tuple, rows)) == fx.SITE_POSTINGS.rows


def test_retry_after_a_busy_answer(spark):
    out = run(spark, "/flaky", max_pages=1, max_depth=0, respect_robots=False)
    row = out.frontier.first()
    assert (row["status"], row["attempts"]) == ("DONE", 2)
    assert out.clock >= crawls.START + timedelta(seconds=2)


def test_budget_cuts_in_claim_order(spark):
    out = run(spark, "/", max_pages=2, max_depth=2)
    assert sorted(r["url"] for r in out.pages.collect()) == ["http://site.example/", "http://site.example/a"]
    assert out.status == "COMPLETED"
    assert {r["status"] for r in out.frontier.collect()} == {"DONE", "PENDING"}


def test_redirects(spark):
    moved = run(spark, "/moved", max_depth=0)
    assert [r["url"] for r in moved.pages.collect()] == ["http://site.example/a"]
    away = run(spark, "/away", max_depth=0).frontier.first()
    assert (away["status"], away["last_error"]) == ("SKIPPED", "Redirect left the permitted host")


def test_endless_redirects_fail_after_retries(spark):
    row = run(spark, "/loop", max_depth=0, max_pages=1).frontier.first()
    assert (row["status"], row["attempts"], row["last_error"]) == ("FAILED", 3, "Too many redirects")


def test_missing_page_fails(spark):
    row = run(spark, "/nothing", max_depth=0).frontier.first()
    assert (row["status"], row["last_error"]) == ("FAILED", "HTTP 404")


def test_robots_are_loaded_once_and_again_after_their_time(spark):
    asked = []

    class Counting:
        def __call__(self, requests):
            asked.extend(r["url"] for r in requests.select("url").collect())
            return spark.createDataFrame([("http://a.example/robots.txt", None, 200, "text/plain", "User-agent: *\nDisallow: /x\nCrawl-delay: 3\n", None, None, None), ("http://b.example/robots.txt", None, 503, None, None, None, None, None)], web.WEB)

    cache = crawls.Robots(Work(spark, "t"), Counting(), None)
    origins = spark.createDataFrame([("http://a.example",), ("http://b.example",), ("http://c.example",)], "origin string")
    now = crawls.micros(crawls.START)
    first = {r["origin"]: r for r in cache.of(origins, now).collect()}
    assert (first["http://a.example"]["delay_ms"], first["http://b.example"]["block_all"], first["http://c.example"]["block_all"]) == (3000, True, False)
    cache.of(origins, now + 899_000_000).collect()
    assert len(asked) == 3
    cache.of(origins, now + 901_000_000).collect()
    assert len(asked) == 6


KNOWN = {"in.example": ["10.0.0.9"], "out.example": ["93.184.216.34"], "both.example": ["93.184.216.34", "::1"], "mapped.example": ["::ffff:127.0.0.1"], "none.example": []}


def test_hosts_are_looked_up_and_checked(spark):
    hosts = [*KNOWN, "unknown.example", "127.0.0.1", "[fe80::1]", "8.8.8.8"]
    rows = spark.createDataFrame([(f"http://{h}/x",) for h in hosts] + [("http://out.example/y",), (None,)], "target string")
    work = Work(spark, "t")
    gate = addresses.Addresses(work.save, lambda h: KNOWN[h])
    got = {r["target"]: (r["unsafe"], r["address"]) for r in gate.gate(rows, 0).collect()}
    good = {k: a for k, (why, a) in got.items() if why is None}
    assert good == {"http://out.example/x": "93.184.216.34", "http://out.example/y": "93.184.216.34", "http://8.8.8.8/x": "8.8.8.8"}
    assert got[None][0] == addresses.NO_HOST and got["http://unknown.example/x"][0] == "Host could not be resolved: unknown.example"
    for h in hosts:
        own = [h] if addresses.is_literal(h) else KNOWN.get(h, [])
        assert addresses.refusal(h, own) == got[f"http://{h}/x"][0], h  # the task's check says the same
    # kept for a time, then asked for again
    work.append(spark.createDataFrame([], "host string"), "asked")
    first = gate.known
    assert gate.gate(rows, 29_000_000).where("unsafe is null").count() == 3
    assert {r["at"] for r in gate.known.collect()} == {r["at"] for r in first.collect()} == {0}
    gate.gate(rows, 31_000_000).count()
    assert {r["at"] for r in gate.known.collect()} == {31_000_000}
    plain = {r["target"]: r["unsafe"] for r in addresses.Addresses(work.save, None).gate(rows, 0).collect()}
    assert {k for k, why in plain.items() if why} == {None, "http://127.0.0.1/x", "http://[fe80::1]/x"}


def test_request_goes_to_the_checked_address(spark, server):
    """The name is connected to by the address that the check saw."""
    root = f"http://name.example:{server.server_port}"
    reader = web.HttpReader({})
    row = reader.get(f"{root}/page", "127.0.0.1")
    assert row[2] == 200 and row[4] == "<title>Café</title>"
    assert server.hosts[-1] == f"name.example:{server.server_port}"

    def fetch(url, attempt, address):
        return {"status": 200, "content_type": "text/html", "body": f"<title>{address}</title>"}

    out = crawl(spark, CrawlSpec("http://out.example/", max_depth=0, respect_robots=False), web.live_web(fetch, pinned=True), lookup=lambda h: KNOWN[h])
    assert [r["title"] for r in out.pages.collect()] == ["93.184.216.34"]
    for host, why in (("both.example", addresses.PRIVATE), ("none.example", "Host could not be resolved: none.example")):
        row = crawl(spark, CrawlSpec(f"http://{host}/", max_depth=0, respect_robots=False), web.live_web(fetch, pinned=True), lookup=lambda h: KNOWN[h]).frontier.first()
        assert (row["status"], row["last_error"]) == ("SKIPPED", why)


def test_private_seed_is_skipped(spark):
    site = spark.createDataFrame([("http://10.1.2.3/", None, 200, "text/html", "<title>in</title>", None, None, None)], web.WEB)
    row = crawl(spark, CrawlSpec("http://10.1.2.3/", max_depth=0, respect_robots=False), site).frontier.first()
    assert row["status"] == "SKIPPED" and row["last_error"].startswith("Private")
    assert crawl(spark, CrawlSpec("http://10.1.2.3/", max_depth=0, respect_robots=False), site, allow_private=True).pages.count() == 1


class Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        self.server.seen.append((self.path, self.headers.get("User-Agent")))
        self.server.hosts.append(self.headers.get("Host"))
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
        elif self.path in ("/page", "/robots.txt", "/large"):
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=ISO-8859-1" if self.path == "/page" else "text/plain")
        else:
            self.send_response(404)
        self.end_headers()
        self.wfile.write({"/page": "<title>Café</title>".encode("latin-1"), "/robots.txt": b"User-agent: *\nDisallow: /no\n", "/large": b"x" * 1_600_000}.get(self.path, b""))

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    s.seen, s.hosts = [], []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_http_source(spark, server):
    root = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(web.HttpPages)
    rows = {r["url"]: r for r in spark.read.format("http_pages").option("urls", f"{root}/page\n{root}/moved\n{root}/large\n{root}/no").option("user_agent", "probe/2").option("allow_private", "true").load().collect()}
    assert (rows[f"{root}/page"]["status"], rows[f"{root}/page"]["body"]) == (200, "<title>Café</title>")
    assert (rows[f"{root}/moved"]["status"], rows[f"{root}/moved"]["location"]) == (302, "/page")  # not followed here
    assert (rows[f"{root}/large"]["error"], rows[f"{root}/large"]["body"]) == ("io", None)
    assert rows[f"{root}/no"]["status"] == 404
    assert {agent for _, agent in server.seen} == {"probe/2"}
    (row,) = spark.read.format("http_pages").option("urls", f"{root}/page").load().collect()
    assert (row["status"], row["error"], row["body"]) == (None, "unsafe", addresses.PRIVATE)


def test_crawl_over_http(spark, server):
    root = f"http://127.0.0.1:{server.server_port}"
    spec = CrawlSpec(f"{root}/moved", max_depth=0, requests_per_second=10)
    out = crawl(spark, spec, web.http_web(), allow_private=True, started=datetime.now(UTC))
    assert [(r["url"], r["title"]) for r in out.pages.collect()] == [(f"{root}/page", "Café")]
    assert [p for p, _ in server.seen] == ["/robots.txt", "/moved", "/page"]


def test_unreachable_server_is_retried_and_fails(spark):
    def refuse(url, attempt):
        raise OSError("refused")

    out = crawl(spark, CrawlSpec("http://127.0.0.1:9/", max_depth=0, respect_robots=False), web.live_web(refuse), allow_private=True)
    row = out.frontier.first()
    assert (row["status"], row["attempts"]) == ("FAILED", 3)
