"""The crawl frontier: claims, state changes, counts, budgets, waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import fetching, scoring

READY = ("PENDING", "RETRY")
OUTSTANDING = ("PENDING", "RETRY", "FETCHING")
RESUMABLE = ("QUEUED", "RUNNING")
TERMINAL = ("COMPLETED", "CANCELLED", "FAILED")


def ready(frontier: DataFrame, as_of: Column) -> DataFrame:
    return frontier.where(F.col("status").isin(*READY) & (F.col("next_attempt_at") <= as_of))


def claim_order(frontier: DataFrame, as_of: Column) -> DataFrame:
    """Ready rows with ``claim``: their turn within the job."""
    w = W.partitionBy("job_id").orderBy("depth", "id")
    return ready(frontier, as_of).withColumn("claim", F.row_number().over(w))


def claim(frontier: DataFrame, as_of: Column, per_job: int = 1) -> DataFrame:
    """The next rows of every job, marked as being fetched."""
    taken = claim_order(frontier, as_of).where(F.col("claim") <= per_job).drop("claim")
    return taken.withColumn("status", F.lit("FETCHING")).withColumn("attempts", F.col("attempts") + 1)


def after_fetch(results: DataFrame, as_of: Column, max_attempts: int = 3, base_seconds: int = 2) -> DataFrame:
    """Frontier rows with their fetch results to their next state.

    ``results`` has the frontier columns, ``http_status``, ``content_type``,
    ``error`` (a kind or null), ``retry_after`` (text) and, if there is a
    better text than the kind, ``error_message``.
    """
    kind = fetching.content_type(F.col("content_type"))
    by_error = fetching.error_state(F.col("error"), F.col("attempts"), max_attempts)
    by_status = fetching.outcome(F.col("http_status"), kind, F.col("attempts"), max_attempts)
    wait = scoring.backoff_seconds(F.col("attempts"), F.when(F.col("error").isNull(), scoring.retry_after(F.col("retry_after"))).otherwise(0), base_seconds)
    state = F.when(F.col("error").isNotNull(), by_error).otherwise(by_status)
    said = F.coalesce("error_message", "error") if "error_message" in results.columns else F.col("error")
    return (
        results.withColumn("status", state)
        .withColumn("next_attempt_at", F.when(state == "RETRY", as_of + F.make_interval(secs=wait)).otherwise(F.col("next_attempt_at")))
        .withColumn("last_error", F.substring(F.when(F.col("error").isNotNull(), said).otherwise(fetching.outcome_message(F.col("http_status"), kind)), 1, 2000))
    )


def requeue(frontier: DataFrame, as_of: Column) -> DataFrame:
    """Recovery: rows that were being fetched are due again at once."""
    stuck = F.col("status") == "FETCHING"
    return frontier.withColumn("next_attempt_at", F.when(stuck, as_of).otherwise(F.col("next_attempt_at"))).withColumn("status", F.when(stuck, "RETRY").otherwise(F.col("status")))


def outstanding(frontier: DataFrame) -> DataFrame:
    """``(job_id, outstanding, next_at)`` of every job."""
    live = F.col("status").isin(*OUTSTANDING)
    soonest = F.min(F.when(F.col("status").isin(*READY), F.col("next_attempt_at")))
    return frontier.groupBy("job_id").agg(F.count_if(live).alias("outstanding"), soonest.alias("next_at"))


def next_due(frontier: DataFrame, now: int) -> tuple[int, int] | None:
    """When the next row may be claimed, and the least depth that is due then.

    Times are microseconds; rows that are due count as due now. None if
    nothing waits.
    """
    at = F.greatest(F.unix_micros("next_attempt_at"), F.lit(now))
    first = frontier.where(F.col("status").isin(*READY)).agg(F.min(F.struct(at.alias("at"), "depth")).alias("d")).first()["d"]
    return (first["at"], first["depth"]) if first else None


def refreshed_counts(jobs: DataFrame, pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """Jobs with their page and failure counts; each table is read once."""
    done = pages.groupBy("job_id").agg(F.count("*").alias("_pages"))
    lost = frontier.where("status = 'FAILED'").groupBy("job_id").agg(F.count("*").alias("_failed"))
    out = jobs.join(done, jobs["id"] == done["job_id"], "left").drop("job_id").join(lost, jobs["id"] == lost["job_id"], "left").drop("job_id")
    return out.withColumn("pages_crawled", F.coalesce("_pages", F.lit(0))).withColumn("pages_failed", F.coalesce("_failed", F.lit(0))).drop("_pages", "_failed")


def within_budget(level: DataFrame, saved: str, already: int, budget: int) -> DataFrame:
    """Rows of a level, in ``rank`` order, until enough of them were saved.

    A row is worked on while fewer than ``budget`` pages were saved before it.
    """
    before = F.sum(F.col(saved).cast("int")).over(W.partitionBy("job_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    return level.withColumn("_before", F.coalesce(before, F.lit(0)) + already).where(F.col("_before") < budget).drop("_before")


def job_after(jobs: DataFrame, action: str, as_of: Column) -> DataFrame:
    """Jobs after a control action; a status that forbids it stays.

    Actions: run, pause, resume, cancel, complete, fail. A finished or
    cancelled job is never reopened by a late worker.
    """
    allowed = {
        "run": ("QUEUED", "RUNNING", "PAUSED", "FAILED"),
        "pause": ("RUNNING", "QUEUED"),
        "resume": ("PAUSED", "FAILED"),
        "cancel": ("QUEUED", "RUNNING", "PAUSED", "FAILED"),
        "complete": ("RUNNING",),
        "fail": ("RUNNING", "QUEUED"),
    }[action]
    to = {"run": "RUNNING", "pause": "PAUSED", "resume": "QUEUED", "cancel": "CANCELLED", "complete": "COMPLETED", "fail": "FAILED"}[action]
    ok = F.col("status").isin(*allowed)
    out = jobs.withColumn("completed_at", F.when(ok, as_of if to in TERMINAL else F.lit(None)).otherwise(F.col("completed_at")))
    if action == "run":
        out = out.withColumn("started_at", F.when(ok, F.coalesce("started_at", as_of)).otherwise(F.col("started_at")))
    return out.withColumn("status", F.when(ok, to).otherwise(F.col("status")))


def launchable(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """Jobs to start or resume after a restart, oldest first, none twice."""
    return jobs.where(F.col("status").isin(*RESUMABLE)).join(active, jobs["id"] == active["job_id"], "left_anti").orderBy("created_at")
