"""Crawls as rounds of DataFrame jobs.

A round claims the due rows of the least depth, as many as the page budget
still allows, in (depth, id) order; a claimed row gives one page at most, so
nothing beyond the budget is asked for. A row that must be retried waits while
others go on. Time is a clock: requests get their slots from the rate limiter,
the clock moves to the last slot of a round, and to the next due row when none
is due; a web that is asked live holds the crawl to the time of day. With a
quantum a round takes only requests whose slot falls within so many seconds,
so that whoever pauses the crawl waits no longer than that.

The limiter's slots and the robots policies are ledgers that crawls share:
slots are reserved by compare and append, so two crawls of an origin, or one
that goes on after a crash, never come closer than the interval.

State is written to the shared folder after each round: pages and postings
are appended, the frontier's changes too, folded into a new base now and then,
so no plan grows with the rounds and a round writes what it changed. A run can
start from a stored frontier. A ``Keeper`` sees every claim and every round,
and its status is read between rounds and while waiting.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import fetching, pages as facts, scoring, urls
from lodestone.operators import addresses, schedule, tables
from lodestone.operators import frontier as fr
from lodestone.operators import robots as rb
from lodestone.plans.ledger import Ledger
from lodestone.plans.spec import CrawlSpec
from lodestone.plans.work import Work
from lodestone.sources import schemas
from lodestone.sources import web as webs

AGENT = "lodestone/1.0"
MAX_ATTEMPTS = 3
QUANTUM = 5.0
DEFAULT: Any = object()
START = datetime(2024, 1, 1, tzinfo=UTC)
PAGE = "frontier_id long, url string, depth int, status_code int, content_type string, title string, body_sha256 string, extracted_text string, outbound_links int"
POSTING = "frontier_id long, source_url string, title string, company string, location string, skills array<string>, experience string, employment_type string, description string, extraction_method string"
LIMITER = "origin string, free_us long"
FOLD_EVERY = 8
FRONTIER_NAMES = [c.split(" ")[0] for c in schemas.CRAWL_FRONTIER.split(", ")]


@dataclass
class Result:
    """Tables of a crawl when it stopped, and its status then."""

    status: str
    pages: DataFrame
    frontier: DataFrame
    postings: DataFrame
    limiter: DataFrame | None = None
    clock: datetime = START


class Keeper:
    """What outlives a run. This one keeps nothing."""

    def status(self) -> str:
        return "RUNNING"

    def claimed(self, rows: DataFrame) -> None:
        """Frontier rows that are about to be asked for."""

    def finished(self, rows: DataFrame, pages: DataFrame, found: DataFrame | None) -> None:
        """A round's changed and new frontier rows, new pages and postings."""


def micros(at: datetime) -> int:
    return round(at.timestamp() * 1_000_000)


def seed_row(spark: SparkSession, job_id: str, url: str, at: datetime) -> DataFrame:
    """The frontier of a new crawl."""
    return spark.createDataFrame([(1, job_id, url, 0, "PENDING", 0, at, None, None, at, at)], schemas.CRAWL_FRONTIER)


def latest_slots(rows: DataFrame) -> DataFrame:
    """The next free slot of each origin: slots only move on."""
    return rows.groupBy("origin").agg(F.max("free_us").alias("free_us"))


def limiter_ledger(spark: SparkSession, root: str) -> Ledger:
    return Ledger(spark, f"{root}/limiter", LIMITER, latest_slots)


def robots_ledger(spark: SparkSession, root: str) -> Ledger:
    def newest(rows: DataFrame) -> DataFrame:
        return rb.fresh(rows, F.lit(rows.agg(F.max("fetched_at")).first()[0]))

    return Ledger(spark, f"{root}/robots", rb.POLICY + ", fetched_at timestamp", newest)


class Robots:
    """Policies of origins, cached for a time.

    ``given``: fetched files ``(origin, status, body)``; origins without a row
    have none. Without it the files are asked from the web itself, once an
    origin and again when older than the limit. ``shared``: a ledger of
    policies that other crawls read and add to as well.
    """

    def __init__(self, work: Work, web, given: DataFrame | None, agent: str = AGENT, ttl: int = rb.CACHE_SECONDS, shared: Ledger | None = None):
        self.work, self.web, self.agent, self.ttl = work, web, agent, ttl
        self.fixed = work.save(rb.policies_of(given, agent), "robots-given") if given is not None else None
        self.ledger = shared or robots_ledger(work.spark, work.root)
        self.turn = 0

    def of(self, targets: DataFrame, now: int) -> DataFrame:
        """Policies for ``targets(origin, address)`` at a time."""
        if self.fixed is not None:
            return self.fixed
        as_of = F.timestamp_micros(F.lit(now))
        live = rb.fresh(self.ledger.read(), as_of, self.ttl)
        addressed = "address" in targets.columns
        wanted = targets.where("origin is not null").groupBy("origin").agg((F.min("address") if addressed else F.lit(None).cast("string")).alias("address"))
        self.turn += 1
        need = self.work.save(wanted.join(live.select("origin"), "origin", "left_anti"), f"robots-need-{self.turn}")
        if not need.isEmpty():
            ask = need.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit(1).alias("attempt"), "origin", "address")
            got = webs.answers(ask, self.web, rb.BODY_CAP)
            files = got.select("origin", F.when(F.col("error").isNull(), F.col("status")).alias("status"), "body")
            loaded = self.work.save(rb.policies_of(files, self.agent).withColumn("fetched_at", as_of), f"robots-{self.turn}")
            self.ledger.add(loaded)
            live = rb.fresh(self.ledger.read(), as_of, self.ttl)
        self.work.drop(f"robots-need-{self.turn - 1}")
        self.work.drop(f"robots-{self.turn - 1}")
        return live.drop("fetched_at")


class Limiter:
    """Slots of requests by origin, reserved in a ledger that crawls may share."""

    def __init__(self, work: Work, per_second: float, free: DataFrame | None = None, shared: Ledger | None = None):
        self.work, self.per_second, self.turn = work, per_second, 0
        self.ledger = shared or limiter_ledger(work.spark, work.root)
        if free is not None:
            self.ledger.add(free.select("origin", "free_us"))

    @property
    def free(self) -> DataFrame:
        return latest_slots(self.ledger.read())

    def pace(self, rows: DataFrame, now: int, until: int | None = None) -> DataFrame:
        """Rows with ``target`` and ``delay_ms`` to rows with ``slot_us``.

        ``until``: rows whose slot is not before it are left out, and nothing
        is reserved for them; slots of an origin rise, so its first rows stay.
        """
        step = schedule.interval_us(F.lit(self.per_second), F.coalesce("delay_ms", F.lit(0)))
        rows = rows.withColumn("_origin", urls.origin(F.col("target"))).withColumn("_step", step)
        while True:
            version = self.ledger.version()
            free = latest_slots(self.ledger.read(version)).withColumnsRenamed({"origin": "_origin", "free_us": "_free"})
            at = F.greatest(F.lit(now), F.coalesce("_free", F.lit(now)))
            slots = schedule.slots(rows.join(free, "_origin", "left").withColumn("_t", at), "_origin", "_t", "_step", ["id"])
            if until is not None:
                slots = slots.where(F.col("slot_us") < until)
            self.turn += 1
            paced = self.work.save(slots.drop("_free", "_t", "wait_us"), f"paced-{self.turn}")
            self.work.drop(f"paced-{self.turn - 2}")
            taken = latest_slots(paced.select(F.col("_origin").alias("origin"), (F.col("slot_us") + F.col("_step")).alias("free_us")).where("origin is not null"))
            if self.ledger.append(taken, version):
                return paced.drop("_origin", "_step")


def _gate(spec: CrawlSpec, robots: Robots | None, allow_private: bool, hosts: addresses.Addresses, save: Callable[[DataFrame, str], DataFrame], clock: Callable[[], int]):
    """Adds ``blocked``, ``delay_ms`` and ``address`` to rows with a ``target``: address, boundary, robots."""

    def gate(rows: DataFrame) -> DataFrame:
        target, seed = F.col("target"), F.lit(spec.seed_url)
        if allow_private:
            rows = rows.withColumn("unsafe", F.lit(None).cast("string")).withColumn("address", F.lit(None).cast("string"))
        else:
            rows = hosts.gate(rows, clock())
        left = fetching.block_reason(F.lit(spec.career), F.lit(spec.same_host_only), urls.career_redirect(seed, target), urls.same_host(seed, target), F.lit(True))
        rows = rows.withColumn("blocked", F.coalesce("unsafe", left)).drop("unsafe")
        if robots is None:
            return rows.withColumn("delay_ms", F.lit(0))
        rows = save(rows, "gated")
        p = robots.of(rows.where("blocked is null").select(urls.origin(target).alias("origin"), "address"), clock())
        p = p.select(F.col("origin").alias("_origin"), F.col("block_all").alias("_block"), F.col("rules").alias("_rules"), "delay_ms")
        rows = rows.join(p, urls.origin(target) == F.col("_origin"), "left")
        allowed = rb.allows(F.col("_block"), F.col("_rules"), urls.robots_target(target))
        return rows.withColumn("blocked", F.coalesce("blocked", F.when(~allowed, "Blocked by robots.txt"))).drop("_origin", "_block", "_rules")

    return gate


def _links(spec: CrawlSpec, saved: DataFrame) -> DataFrame:
    """``(id, depth, from_url, pos, url)`` of links that may be followed."""
    rows = saved.select("id", "depth", F.col("final_url").alias("from_url"), F.posexplode("facts.links").alias("pos", "link"))
    rows = rows.select("id", "depth", "from_url", "pos", F.col("link.url").alias("url"), F.col("link.anchor").alias("anchor"))
    seed = F.lit(spec.seed_url)
    if spec.career:
        rows = rows.where(urls.career_follow(seed, F.col("from_url"), F.col("url"), F.col("anchor")))
    elif spec.same_host_only:
        rows = rows.where(urls.same_host(seed, F.col("url")))
    rows = rows.where(F.length("url") <= 2048)  # longer ones fit no key
    return rows.groupBy("id", "depth", "from_url", "url").agg(F.min("pos").alias("pos"))


def numbered(work: Work, rows: DataFrame, order: list[str], start: int, name: str) -> tuple[DataFrame, int]:
    """Rows with ``number`` in a global order, from ``start``, and their count.

    Ranges of the order are partitions; their sizes, a row each, give every
    range its first number, so no task sees all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = work.save(ranged, name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each range
    first, upto = {}, start
    for r in sizes:
        first[r["_part"]], upto = upto, upto + r["n"]
    base = F.get(F.array(*(F.lit(first.get(k, 0)).cast("long") for k in range(max(first, default=0) + 1))), part.cast("int"))  # a map is searched from its start for every row
    return ranged.withColumn("number", base + place).drop("_at"), upto - start


class Front:
    """The frontier during a run: a base table and the changes since, folded together now and then."""

    def __init__(self, work: Work, rows: DataFrame):
        self.work, self.base, self.turn = work, work.save(rows.select(*FRONTIER_NAMES), "frontier-0"), 0
        self.changes: DataFrame | None = None

    def rows(self) -> DataFrame:
        if self.changes is None:
            return self.base
        now = tables.latest(self.changes, ["id"], ["turn"]).select(*FRONTIER_NAMES)
        return self.base.join(now.select("id"), "id", "left_anti").unionByName(now)

    def change(self, rows: DataFrame) -> DataFrame:
        """Adds changed and new rows; gives them back as stored."""
        if self.turn % FOLD_EVERY == FOLD_EVERY - 1:
            k = self.turn // FOLD_EVERY
            self.base, self.changes = self.work.save(self.rows(), f"frontier-{k + 1}"), None
            self.work.drop(f"frontier-{k}")
            self.work.drop(f"changes-{k}")
        self.turn += 1
        self.changes = self.work.append(rows.select(*FRONTIER_NAMES).withColumn("turn", F.lit(self.turn)), f"changes-{self.turn // FOLD_EVERY}")
        return self.changes.where(F.col("turn") == self.turn).drop("turn")


def per_quantum(rows: DataFrame, per_second: float, quantum: float | None) -> DataFrame:
    """Due rows of which no origin has more than its rate allows in the quantum, one at least."""
    if quantum is None:
        return rows
    most = max(1, int(quantum * max(0.1, per_second)))
    rank = F.row_number().over(W.partitionBy(urls.origin(F.col("canonical_url"))).orderBy("id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def crawl(
    spark: SparkSession, spec: CrawlSpec, web, robots: DataFrame | None = None, allow_private: bool = False, max_attempts: int = MAX_ATTEMPTS, *,
    job_id: str = "job", frontier: DataFrame | None = None, saved: DataFrame | None = None, limiter: DataFrame | None = None,
    started: datetime = START, keeper: Keeper | None = None, lookup: addresses.Lookup | None = DEFAULT, shared: str | None = None, quantum: float | None = DEFAULT,
) -> Result:
    """Crawl ``web`` from the seed of ``spec``, or from a stored ``frontier``.

    ``web``: a table of answers, or a function from requests ``(url, attempt,
    slot_us, address)`` to one (see ``sources.web``). ``saved(url)``: pages that
    an earlier run has stored. ``lookup``: addresses of a host; by default
    names are looked up unless the web is a table, which opens no connection.
    ``shared``: a folder whose limiter and robots ledgers this crawl shares
    with others. ``quantum``: seconds of requests a round takes; by default 5
    if the web is asked live. The driver loops over rounds and holds counters.
    """
    live = getattr(web, "live", False)
    lookup = (addresses.system_addresses if callable(web) else None) if lookup is DEFAULT else lookup
    quantum = (QUANTUM if live else None) if quantum is DEFAULT else quantum
    work, keeper = Work(spark, "crawl"), keeper or Keeper()
    now, step = micros(started), 0

    def save(df: DataFrame, name: str) -> DataFrame:
        made.append(f"{name}-{step}-{len(made)}")
        return work.save(df, made[-1])

    made: list[str] = []
    policies = Robots(work, web, robots, shared=robots_ledger(spark, shared) if shared else None) if spec.respect_robots else None
    gate = _gate(spec, policies, allow_private, addresses.Addresses(save, lookup), save, lambda: now)
    limits = Limiter(work, spec.requests_per_second, limiter, limiter_ledger(spark, shared) if shared else None)
    if frontier is None:
        frontier = seed_row(spark, job_id, spec.seed_url, started)
    front = Front(work, fr.requeue(frontier, F.lit(started)))
    earlier = saved.select("url") if saved is not None else spark.createDataFrame([], "url string")
    n_saved, next_id = earlier.count(), (front.base.agg(F.max("id")).first()[0] or 0) + 1
    pages = work.append(spark.createDataFrame([], PAGE + ", round int"), "pages")
    found = work.append(spark.createDataFrame([], POSTING + ", round int"), "postings")
    while True:
        status = keeper.status()
        if status in ("PAUSED", "CANCELLED"):
            break
        status = "COMPLETED"
        if n_saved >= spec.max_pages:
            break
        rows = front.rows()
        soonest = fr.next_due(rows, now)
        if soonest is None:
            break
        now, head = soonest
        if live and not _wait(now, keeper):
            continue
        as_of, this = F.timestamp_micros(F.lit(now)), F.col("round") == step + 1
        step, old, made = step + 1, made, []
        due = per_quantum(fr.ready(rows.where(F.col("depth") == head), as_of), spec.requests_per_second, quantum).orderBy("id").limit(spec.max_pages - n_saved)
        due = save(due, "due")
        taken = fr.claim(due, as_of, spec.max_pages).withColumn("updated_at", as_of)
        keeper.claimed(taken)
        asked = taken.select("id", F.col("canonical_url").alias("url"), "depth", F.col("attempts").alias("attempt"))
        until = None if quantum is None else now + round(quantum * 1_000_000)
        got = webs.follow(asked, web, gate, urls.canonicalize, save, lambda rows, hop: limits.pace(rows, now, None if hop else until))  # noqa: B023
        results = taken.join(got.select("id", F.col("status").alias("http_status"), "content_type", "error", "error_message", "retry_after", "slot_us"), "id")
        at = F.timestamp_micros(F.coalesce("slot_us", F.lit(now)))
        moved = save(fr.after_fetch(results, at, max_attempts).withColumn("updated_at", at).select(*FRONTIER_NAMES), "moved")
        left_out = due.join(moved.select("id"), "id", "left_anti")
        last = moved.agg(F.max(F.unix_micros("updated_at"))).first()[0]
        if last is None:  # every origin's next slot lies beyond the quantum: go there
            keeper.finished(left_out, pages.where("false").drop("round"), None)
            origins = due.select(urls.origin(F.col("canonical_url")).alias("origin"))
            now = max(now, origins.join(limits.free, "origin").agg(F.min("free_us")).first()[0] or now + 1)
            _drop(work, old)
            continue
        now = last
        have = pages.select("url").unionByName(earlier).withColumnRenamed("url", "final_url")
        done = got.join(moved.where("status = 'DONE'").select("id"), "id", "left_semi")
        done = tables.keep_first(done, ["final_url"], ["id"]).join(have, "final_url", "left_anti")
        done = done.withColumn("kind", fetching.content_type(F.col("content_type"))).withColumn("body_sha256", scoring.fingerprint(F.col("body")))
        done = save(done.withColumn("facts", facts.page_facts("final_url", "body", spec.career)).drop("body"), "done")
        links = save(_links(spec, done), "links")
        counts = links.groupBy("id").agg(F.count("*").cast("int").alias("outbound_links"))
        page = done.join(counts, "id", "left").select(
            F.col("id").alias("frontier_id"), F.col("final_url").alias("url"), "depth", F.col("status").alias("status_code"), F.col("kind").alias("content_type"),
            scoring.truncated(F.col("facts.title"), 1000).alias("title"), "body_sha256",
            scoring.truncated(F.col("facts.text"), 50_000).alias("extracted_text"), F.coalesce("outbound_links", F.lit(0)).alias("outbound_links"), F.lit(step).alias("round"),
        )
        pages = work.append(page, "pages")
        post = None
        if spec.career:
            post = done.select(F.col("id").alias("frontier_id"), F.col("final_url").alias("source_url"), facts.posting_of(F.col("facts")).alias("p")).where("p is not null")
            found = work.append(post.select("frontier_id", "source_url", "p.*", F.lit(step).alias("round")), "postings")
            post = found.where(this).drop("round")
        fresh = tables.keep_first(links, ["url"], ["id", "pos"]).join(rows.select(F.col("canonical_url").alias("url")), "url", "left_anti")
        fresh, n_fresh = numbered(work, fresh if head < spec.max_depth else fresh.limit(0), ["id", "pos"], next_id, f"fresh-{step}")
        made.append(f"fresh-{step}")
        at = F.timestamp_micros(F.lit(now))
        fresh = fresh.select(
            F.col("number").alias("id"), F.lit(job_id).alias("job_id"), F.col("url").alias("canonical_url"), (F.col("depth") + 1).cast("int").alias("depth"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"),
            at.alias("next_attempt_at"), F.col("from_url").alias("discovered_from"), F.lit(None).cast("string").alias("last_error"), at.alias("created_at"), at.alias("updated_at"),
        )
        changed = front.change(moved.unionByName(fresh))
        keeper.finished(changed.unionByName(left_out), pages.where(this).drop("round"), post)
        n_saved += pages.where(this).count()
        next_id += n_fresh
        _drop(work, old)
    return Result(status, pages.drop("round"), front.rows(), found.drop("round"), limits.free, datetime.fromtimestamp(now / 1_000_000, UTC))


def _drop(work: Work, names: list[str]) -> None:
    """Drops a round's tables; addresses are read by the next round."""
    for name in names:
        work.drop(name)


def _wait(until: int, keeper: Keeper) -> bool:
    """Sleeps until a time of day; False if the status changes meanwhile."""
    while (rest := until / 1_000_000 - time.time()) > 0:
        if keeper.status() in ("PAUSED", "CANCELLED"):
            return False
        time.sleep(min(1.0, rest))
    return True
