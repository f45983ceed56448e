"""State that crawls share: limiter, robots, versions, and pauses."""

import random
import re
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import fixtures as fx
from lodestone.operators import addresses, robots
from lodestone.plans import crawl as crawls
from lodestone.plans.crawl import crawl
from lodestone.plans.ledger import SNAPSHOT_EVERY, Ledger
from lodestone.plans.service import Service, names_of
from lodestone.plans.spec import CrawlSpec, ValidationError
from lodestone.plans.work import Work
from lodestone.sources import schemas, web


def test_ledger_gives_each_version_to_one_writer(spark):
    root = Work(spark, "ledger").root
    a, b = (Ledger(spark, f"{root}/x", "k long, n long") for _ in range(2))
    row = lambda k, n: spark.createDataFrame([(k, n)], "k long, n long")
    assert a.version() == b.version() == -1 and a.read().count() == 0
    assert a.append(row(1, 1), -1) and not b.append(row(2, 2), -1)
    assert b.append(row(2, 2), b.version())
    threads = [threading.Thread(target=x.add, args=(row(3, k),)) for k, x in enumerate((a, b, a, b))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(tuple, a.read().collect())) == [(1, 1), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3)]


def test_ledger_folds_what_still_counts(spark):
    root = Work(spark, "ledger").root
    ledger = Ledger(spark, f"{root}/x", crawls.LIMITER, crawls.latest_slots)
    for k in range(2 * SNAPSHOT_EVERY + 2):
        ledger.add(spark.createDataFrame([(f"o{k % 3}", k)], crawls.LIMITER))
    rows = ledger.read().collect()
    assert len(rows) < 8 and crawls.latest_slots(ledger.read()).count() == 3
    fresh = Ledger(spark, f"{root}/x", crawls.LIMITER)
    assert sorted(map(tuple, fresh.read().collect())) == sorted(map(tuple, rows))
    assert min(fresh.entries) >= SNAPSHOT_EVERY - 1  # what two snapshots stand for is gone


def site(spark, pages, robots_file=None):
    links = "".join(f'<a href="/{k}">x</a>' for k in range(1, pages))
    rows = [(f"http://site.example/{k or ''}", None, 200, "text/html", f"<title>{k}</title>{links if not k else ''}", None, None, None) for k in range(pages)]
    if robots_file:
        rows.append(("http://site.example/robots.txt", None, 200, "text/plain", robots_file, None, None, None))
    return spark.createDataFrame(rows, web.WEB)


def slots_of(frontier):
    return sorted(r["t"] for r in frontier.where("status = 'DONE'").select((F.unix_micros("updated_at") / 1e6).alias("t")).collect())


def test_crawls_of_one_origin_keep_the_interval(spark):
    """Two at the same time, and one after them."""
    root, out = Work(spark, "shared").root, {}
    spec = CrawlSpec("http://site.example/", max_depth=1, requests_per_second=2.0, respect_robots=False)

    def run(name):
        out[name] = slots_of(crawl(spark, spec, site(spark, 4), shared=root).frontier)

    threads = [threading.Thread(target=run, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    run("c")
    slots = sorted(out["a"] + out["b"] + out["c"])
    assert len(slots) == 12 and all(b - a >= 0.5 for a, b in zip(slots, slots[1:]))


def test_policies_are_shared_and_end(spark):
    root = Work(spark, "shared").root
    asked = []

    class Counting:
        def __call__(self, requests):
            asked.extend(r["url"] for r in requests.select("url").collect())
            return spark.createDataFrame([("http://a.example/robots.txt", None, 200, "text/plain", "User-agent: *\nCrawl-delay: 3\n", None, None, None)], web.WEB)

    origins = spark.createDataFrame([("http://a.example",)], "origin string")
    of = lambda: crawls.Robots(Work(spark, "t"), Counting(), None, shared=crawls.robots_ledger(spark, root))
    now = crawls.micros(crawls.START)
    assert [r["delay_ms"] for r in of().of(origins, now).collect()] == [3000]
    assert [r["delay_ms"] for r in of().of(origins, now + 899_000_000).collect()] == [3000] and len(asked) == 1
    of().of(origins, now + 901_000_000).collect()
    assert len(asked) == 2


class PausedAt(crawls.Keeper):
    """Pauses when the clock has passed a time; notes when each round ended."""

    def __init__(self):
        self.claims, self.done = [], []

    def claimed(self, rows):
        self.claims.append(rows.count())

    def finished(self, rows, pages, found):
        self.done.append(rows.where("status = 'DONE'").agg(F.max(F.unix_micros("updated_at"))).first()[0])


def test_rounds_take_no_longer_than_the_quantum(spark):
    for robots_file, most in ((None, 3), ("User-agent: *\nCrawl-delay: 2\n", 2)):
        keeper = PausedAt()
        out = crawl(spark, CrawlSpec("http://site.example/", max_depth=1, respect_robots=robots_file is not None), site(spark, 8, robots_file), keeper=keeper, quantum=3.0)
        slots = slots_of(out.frontier)
        step = 1 if robots_file is None else 2
        assert [round(b - a) for a, b in zip(slots, slots[1:])] == [step] * 7  # nothing is lost or asked twice
        ends = [d / 1e6 for d in keeper.done if d]
        assert all(sum(1 for s in slots if a < s <= b) <= most for a, b in zip([0, *ends], ends))
        assert all(r["attempts"] == 1 for r in out.frontier.collect())


def test_live_crawl_pauses_while_it_waits(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/engine", lookup=fx.lookup)
    s.crawl_options = {"quantum": 2.0}
    links = "".join(f'<a href="/{k}">x</a>' for k in range(1, 40))

    def fetch(url, attempt):
        return {"status": 200, "content_type": "text/html", "body": f"<title>x</title>{links}"}

    job = s.create(CrawlSpec("http://site.example/", max_pages=40, max_depth=1, requests_per_second=0.5, respect_robots=False))
    done = s.launch(job, web.live_web(fetch, wait=True))
    while s.frontier(job).where("status = 'DONE'").count() < 2:
        time.sleep(1)
    s.control(job, "pause")
    assert done.result(timeout=60) == "PAUSED"
    rows = s.frontier(job).groupBy("status").count().collect()
    assert {r["status"] for r in rows} == {"DONE", "PENDING"}  # what was claimed and not asked for is back


def test_localhost_is_refused_by_default(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/engine")
    for url in ("http://localhost/", "http://127.0.0.1/", "http://[::1]/"):
        with pytest.raises(ValidationError) as e:
            s.create(CrawlSpec(url))
        assert e.value.fields == {"seed_url": addresses.PRIVATE}
    assert s.jobs().count() == 0


def test_service_with_a_web_launches(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/engine", clock=lambda: datetime(2024, 5, 1), lookup=fx.lookup, web=site(spark, 2), robots=fx.SITE_ROBOTS.frame(spark))
    job = s.create(CrawlSpec("http://site.example/", max_depth=0))
    s._pool.shutdown(wait=True)
    assert s.get(job).first()["status"] == "COMPLETED"


def test_many_versions_are_pruned_and_folded(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/engine", clock=lambda: datetime(2024, 5, 1), lookup=fx.lookup)
    job = s.create(CrawlSpec("http://site.example/"))
    other = spark.range(10_000).selectExpr("concat('job', id % 20) AS id", "id AS version")
    empty = spark.createDataFrame([], schemas.CRAWL_JOB + ", version long")
    s._append(empty.unionByName(other, allowMissingColumns=True).select(*names_of(schemas.CRAWL_JOB + ", version long")).repartition("id"), "crawl_job")
    files = s._read("crawl_job", schemas.CRAWL_JOB + ", version long", id=job).inputFiles()
    assert len(files) == 1 and job in files[0]
    assert s.get(job).first()["status"] == "QUEUED" and s.jobs().count() == 21
    row = s.frontier(job).first()
    for k in range(60):
        s._put_frontier(job, spark.createDataFrame([row], schemas.CRAWL_FRONTIER).withColumn("attempts", F.lit(k)))
    s._fold(job)
    assert len(s._versions(job)) == 1 and [r["attempts"] for r in s.frontier(job).collect()] == [59]


def test_globs_against_regular_expressions(spark):
    rnd, rows = random.Random(3), []
    for k in range(1500):
        rules = ["".join(rnd.choice("/ab*.?$") for _ in range(rnd.randrange(1, 7))) + rnd.choice(["", "$", "*"]) for _ in range(3)]
        body = "User-agent: *\n" + "".join(f"{rnd.choice(['Allow', 'Disallow'])}: {r}\n" for r in rules)
        rows.append((f"o{k}", 200, body, "/" + "".join(rnd.choice("/ab.?$") for _ in range(rnd.randrange(0, 8)))))
    df = spark.createDataFrame(rows, "origin string, status int, body string, target string")
    p = robots.policies_of(df.select("origin", "status", "body"), "x")
    allowed = robots.allows(F.col("block_all"), F.col("rules"), F.col("target")).alias("a")
    got = {r["origin"]: r["a"] for r in df.join(p, "origin").select("origin", allowed).collect()}

    def plainly(body, target):
        best = (-1, True)
        for line in body.split("\n")[1:-1]:
            kind, value = line.split(": ", 1)
            end = value.endswith("$")
            parts = (value[:-1] if end else value).split("*")
            if re.fullmatch(".*".join(map(re.escape, parts)) + ("" if end else ".*"), target):
                best = max(best, (len("".join(parts)), kind == "Allow"))
        return best[1]

    assert [r[0] for r in rows if got[r[0]] != plainly(r[2], r[3])] == []
