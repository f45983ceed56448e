"""The engine's operations over stored tables.

Tables are Parquet folders under one root, partitioned by job, so what is
asked of a job reads its folder only. Nothing is updated in place: jobs and
frontier rows are versions, appended with a number, and the latest version of
an id counts; a frontier of many versions is folded into one. A running crawl
appends its claims before it asks and each round's rows after it, and reads its
job's status between rounds and while it waits: it can be paused, cancelled and
resumed, and after a crash goes on from the stored frontier. One process works
on a job once at a time. All crawls of a root share the rate limiter's slots
and the robots policies.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import UTC, datetime
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import frontier as fr
from lodestone.operators import addresses, matching, tables
from lodestone.plans import crawl as crawls
from lodestone.plans.spec import CareerSpec, CrawlSpec, MatchSpec, NotFound, ValidationError
from lodestone.sources import export, schemas

VERSIONED = schemas.CRAWL_JOB + ", version long"
FRONTIER = schemas.CRAWL_FRONTIER + ", version long"
PARTITIONS = {"crawl_job": ["id"], "crawl_frontier": ["job_id", "version"], "crawled_page": ["job_id"], "job_posting": ["scan_id"]}
FOLD_VERSIONS = 40


def names_of(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


def tag_of(job_id: str) -> str:
    return f"crawl-{job_id}"


class StoreKeeper(crawls.Keeper):
    """Writes a running crawl's claims and rounds to the store."""

    def __init__(self, service: Service, job_id: str):
        self.service, self.job_id = service, job_id

    def status(self) -> str:
        return self.service._one(self.job_id).first()["status"]

    def claimed(self, rows: DataFrame) -> None:
        self.service._put_frontier(self.job_id, rows)

    def finished(self, rows: DataFrame, pages: DataFrame, found: DataFrame | None) -> None:
        # pages go first: a crash between the two repeats a request, and loses nothing
        self.service._save_pages(self.job_id, pages, found)
        self.service._put_frontier(self.job_id, rows)


class Service:
    """Crawls, career scans, listings, exports and matches.

    ``lookup``: addresses of a host, for the address check of names, which
    ``allow_private`` switches off. With a ``web`` of its own a service
    launches crawls when they are created or resumed.
    """

    def __init__(
        self, spark: SparkSession, root: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None),
        allow_private: bool = False, lookup: addresses.Lookup = addresses.system_addresses, workers: int = 4, web=None, robots: DataFrame | None = None,
    ):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.allow_private, self.lookup, self.workers, self.web, self.robots = allow_private, lookup, workers, web, robots
        self.crawl_options: dict = {}  # more arguments of every crawl, such as ``quantum``
        self._lock, self._active = threading.RLock(), set()
        self._pool: ThreadPoolExecutor | None = None

    # tables

    def _read(self, name: str, schema: str, **of: str) -> DataFrame:
        """A table, or the folder of one job of it."""
        path = "/".join([f"{self.root}/{name}", *(f"{k}={v}" for k, v in of.items())])
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(path).select(*names_of(schema))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{self.root}/{name}")

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def jobs(self) -> DataFrame:
        """All crawls, newest first."""
        return tables.latest(self._read("crawl_job", VERSIONED), ["id"], ["version"]).drop("version").orderBy(F.desc("created_at"), "id")

    def _put(self, job: DataFrame) -> None:
        """A job's next version."""
        with self._lock:
            row = job.first()
            last = self._read("crawl_job", VERSIONED, id=row["id"]).agg(F.max("version")).first()[0]
            out = self.spark.createDataFrame([row], job.schema).withColumn("version", F.lit(0 if last is None else last + 1).cast("long"))
            self._append(out.withColumn("updated_at", F.lit(self.clock())).select(*names_of(VERSIONED)), "crawl_job")

    def _one(self, job_id: str) -> DataFrame:
        rows = self._read("crawl_job", VERSIONED, id=job_id)
        found = tables.latest(rows.where(F.col("id") == job_id), ["id"], ["version"]).drop("version")
        if found.isEmpty():
            raise NotFound(f"no crawl {job_id}")
        return found

    def frontier(self, job_id: str) -> DataFrame:
        """A crawl's frontier as it is now."""
        rows = self._read("crawl_frontier", FRONTIER, job_id=job_id)
        return tables.latest(rows, ["job_id", "id"], ["version"]).drop("version")

    def _versions(self, job_id: str) -> list[int]:
        """Versions of a job's frontier, from the names of their folders."""
        path, fs = self._folder(f"crawl_frontier/job_id={job_id}")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removeprefix("version=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("version="))

    def _put_frontier(self, job_id: str, rows: DataFrame) -> None:
        with self._lock:
            last = max(self._versions(job_id), default=-1)
            self._append(rows.withColumn("version", F.lit(last + 1).cast("long")).select(*names_of(FRONTIER)), "crawl_frontier")

    def _fold(self, job_id: str) -> None:
        """Writes the frontier as one version if it has many, then deletes the older ones."""
        with self._lock:
            old = self._versions(job_id)
            if len(old) > FOLD_VERSIONS:
                self._put_frontier(job_id, self.frontier(job_id))
                for v in old:
                    path, fs = self._folder(f"crawl_frontier/job_id={job_id}/version={v}")
                    fs.delete(path, True)

    def _requeue(self, job_id: str) -> None:
        stuck = self.frontier(job_id).where("status = 'FETCHING'")
        if not stuck.isEmpty():
            self._put_frontier(job_id, fr.requeue(stuck, F.lit(self.clock())).withColumn("updated_at", F.lit(self.clock())))

    def _counted(self, job: DataFrame, job_id: str) -> DataFrame:
        pages = self._read("crawled_page", schemas.CRAWLED_PAGE, job_id=job_id)
        out = fr.refreshed_counts(job, pages, self.frontier(job_id))
        return out.withColumn("pages_crawled", F.col("pages_crawled").cast("int")).withColumn("pages_failed", F.col("pages_failed").cast("int"))

    # crawls

    def create(self, spec: CrawlSpec) -> str:
        """A queued crawl with its seed, launched if the service has a web; a career scan also gets its scan row, first."""
        host = urlsplit(spec.seed_url).hostname
        if not self.allow_private:
            why = addresses.refusal(host, [host] if host and addresses.is_literal(host) else self.lookup(host or ""))
            if why is not None:
                raise ValidationError({"seed_url": why})
        job_id, now = str(uuid.uuid4()), self.clock()
        row = (job_id, spec.seed_url, host, spec.max_pages, spec.max_depth, spec.same_host_only, spec.respect_robots, float(spec.requests_per_second), "QUEUED", 0, 0, now, None, None, now, None)
        if spec.career:
            self._append(self.spark.createDataFrame([(job_id, spec.seed_url, now)], schemas.CAREER_SCAN), "career_scan")
        self._put(self.spark.createDataFrame([row], schemas.CRAWL_JOB))
        self._put_frontier(job_id, crawls.seed_row(self.spark, job_id, spec.seed_url, now))
        if self.web is not None:
            self.launch(job_id, self.web, self.robots)
        return job_id

    def get(self, job_id: str) -> DataFrame:
        return self._one(job_id)

    def control(self, job_id: str, action: str) -> str:
        """pause, resume or cancel; ValidationError if the status forbids it."""
        job = self._one(job_id)
        after = fr.job_after(job, action, F.lit(self.clock()))
        old, new = job.first()["status"], after.first()["status"]
        if old == new:
            raise ValidationError({"status": f"{old} can't {action}"})
        if action == "resume":
            self._requeue(job_id)
        self._put(after)
        if action == "cancel":
            self.spark.sparkContext.cancelJobsWithTag(tag_of(job_id))  # what it runs just now
        elif action == "resume" and self.web is not None:
            self.launch(job_id, self.web, self.robots)
        return new

    def run(self, job_id: str, web, robots: DataFrame | None = None) -> str:
        """Work on a crawl until its budget or frontier is used up, or it is paused or cancelled.

        A job that is being worked on already is left to that worker. An
        interrupt pauses the job, an error fails it; either way what was
        saved stays, and the counts are brought up to date.
        """
        with self._lock:
            if job_id in self._active:
                return self._one(job_id).first()["status"]
            self._active.add(job_id)
        try:
            return self._work(job_id, web, robots)
        finally:
            with self._lock:
                self._active.discard(job_id)

    def _work(self, job_id: str, web, robots: DataFrame | None) -> str:
        job = self._one(job_id).first()
        if job["status"] not in ("QUEUED", "RUNNING", "PAUSED", "FAILED"):
            return job["status"]
        self._requeue(job_id)
        self._put(fr.job_after(self._one(job_id), "run", F.lit(self.clock())))
        kind = CareerSpec if self._is_scan(job_id) else CrawlSpec
        more = {} if kind is CareerSpec else {"same_host_only": job["same_host_only"], "respect_robots": job["respect_robots"]}
        spec = kind(job["seed_url"], max_pages=job["max_pages"], max_depth=job["max_depth"], requests_per_second=job["requests_per_second"], **more)
        saved = self._read("crawled_page", schemas.CRAWLED_PAGE, job_id=job_id).select("url")
        action, message = None, None
        self.spark.sparkContext.addJobTag(tag_of(job_id))
        try:
            out = crawls.crawl(
                self.spark, spec, web, robots, self.allow_private, job_id=job_id, frontier=self.frontier(job_id), saved=saved,
                started=self.clock(), keeper=StoreKeeper(self, job_id), lookup=self.lookup, shared=f"{self.root}/shared", **self.crawl_options,
            )
            action = "complete" if out.status == "COMPLETED" else None
        except KeyboardInterrupt:
            action, message = "pause", "Worker interrupted; safe to resume"
            raise
        except Exception as e:
            self.spark.sparkContext.removeJobTag(tag_of(job_id))
            if self._one(job_id).first()["status"] != "CANCELLED":
                action, message = "fail", str(e)[:2000]
                raise
        finally:
            self.spark.sparkContext.removeJobTag(tag_of(job_id))
            with self._lock:
                self._fold(job_id)
                now = self._counted(self._one(job_id), job_id)
                after = fr.job_after(now, action, F.lit(self.clock())) if action else now
                if message is not None:
                    after = after.withColumn("error_message", F.lit(message))
                self._put(after)
        return self._one(job_id).first()["status"]

    def launch(self, job_id: str, web, robots: DataFrame | None = None) -> Future:
        """``run`` on a thread of its own."""
        self._one(job_id)
        with self._lock:
            self._pool = self._pool or ThreadPoolExecutor(self.workers)
        return self._pool.submit(self.run, job_id, web, robots)

    def recover(self, web, robots: DataFrame | None = None) -> list[Future]:
        """After a restart: launch every queued or running crawl that nobody works on."""
        with self._lock:
            active = self.spark.createDataFrame([(x,) for x in self._active], "job_id string")
        return [self.launch(r["id"], web, robots) for r in self.to_recover(active).select("id").collect()]

    def _save_pages(self, job_id: str, rows: DataFrame, found: DataFrame | None) -> None:
        now, job = F.lit(self.clock()), F.lit(job_id)
        ident = F.concat_ws("-", job, F.col("frontier_id").cast("string"))
        pages = rows.select(ident.alias("id"), job.alias("job_id"), "url", "depth", "status_code", "content_type", "title", "body_sha256", "extracted_text", "outbound_links", now.alias("fetched_at"))
        self._append(tables.set_insert(self._read("crawled_page", schemas.CRAWLED_PAGE, job_id=job_id), pages, ["job_id", "url"], ["id"]), "crawled_page")
        if found is None:
            return
        posts = found.select(ident.alias("id"), job.alias("scan_id"), ident.alias("page_id"), "source_url", "title", "company", "location", "skills", "experience", "employment_type", "description", "extraction_method", now.alias("discovered_at"))
        self._append(tables.set_insert(self._read("job_posting", schemas.JOB_POSTING, scan_id=job_id), posts, ["scan_id", "source_url"], ["id"]), "job_posting")

    def pages(self, job_id: str, limit: int = 100) -> DataFrame:
        """A crawl's pages with a short preview of their text."""
        self._one(job_id)
        rows = self._read("crawled_page", schemas.CRAWLED_PAGE, job_id=job_id)
        return tables.listing(rows, ["fetched_at", "url"], limit).select("id", "url", "depth", "status_code", "content_type", "title", "body_sha256", scoring.preview(F.col("extracted_text")).alias("preview"), "outbound_links", "fetched_at")

    def to_recover(self, active: DataFrame) -> DataFrame:
        return fr.launchable(self.jobs(), active)

    # career scans

    def _is_scan(self, job_id: str) -> bool:
        return not self._read("career_scan", schemas.CAREER_SCAN).where(F.col("job_id") == job_id).isEmpty()

    def scans(self) -> DataFrame:
        """Scans with their crawl's state and number of postings, newest first."""
        counts = self._read("job_posting", schemas.JOB_POSTING).groupBy(F.col("scan_id").alias("job_id")).agg(F.count("*").alias("postings"))
        scan = self._read("career_scan", schemas.CAREER_SCAN)
        jobs = self.jobs().select(F.col("id").alias("job_id"), "status", "pages_crawled", "pages_failed", "error_message")
        return scan.join(jobs, "job_id").join(counts, "job_id", "left").withColumn("postings", F.coalesce("postings", F.lit(0))).orderBy(F.desc("created_at"), "job_id")

    def scan(self, job_id: str) -> DataFrame:
        found = self.scans().where(F.col("job_id") == job_id)
        if found.isEmpty():
            raise NotFound(f"no career scan {job_id}")
        return found

    def postings(self, job_id: str) -> DataFrame:
        self._one(job_id)
        if not self._is_scan(job_id):
            raise NotFound(f"no career scan {job_id}")
        return self._read("job_posting", schemas.JOB_POSTING, scan_id=job_id).orderBy("discovered_at", "title")

    def download(self, job_id: str, kind: str) -> DataFrame:
        """One row ``(filename, mime, payload)``; ``kind`` is json or csv."""
        return {"json": export.json_document, "csv": export.csv_document}[kind](self.postings(job_id))

    def match(self, job_id: str, spec: MatchSpec, ask: Callable[[dict], str] | None = None, model: str = "") -> matching.Report:
        return matching.match(self.postings(job_id), spec.resume, spec.use_ai, ask, model)
