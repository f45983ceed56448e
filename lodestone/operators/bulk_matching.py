"""Many résumés against many postings: the best by skill overlap, and an outside matcher asked by the tasks."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scoring, skills
from lodestone.operators import matching, tables
from lodestone.plans.work import Work

TOP = 10
FLOORS = (100, 70, 0)  # a round looks at scores from here on; the last at all
BLOCK = 50_000  # skill sets of résumés that meet one list of postings in one task
SALTS = 16
NAMES = tuple(name for name, _ in skills.CATALOG)
ASKED = "_row long, text string, attempts int, error string"


def skill_bits(names: Column, vocabulary: Sequence[str]) -> Column:
    """A set of skills as a long: bit k for the k-th name; other names have no bit."""
    if len(vocabulary) > 63:
        raise ValueError("at most 63 skills fit a long")
    known = F.split(F.lit("\x1f".join(vocabulary)), "\x1f")  # one literal, not one for each name

    def bit(name: Column) -> Column:
        at = F.array_position(known, name).cast("int")
        return F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at - 1)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(names, F.lit(0).cast("long"), lambda out, n: out.bitwiseOR(bit(n)))


def rarest_first(jobs: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary by the number of postings; a row for each skill is collected."""
    found = jobs.select(F.explode("skills").alias("s")).where(F.col("s").isin(list(vocabulary))).groupBy("s").count().collect()
    count = {r["s"]: r["count"] for r in found}
    return sorted(vocabulary, key=lambda n: (count.get(n, 0), n))


def best_matches(resumes: DataFrame, jobs: DataFrame, top: int = TOP, vocabulary: Sequence[str] = NAMES, work: Work | None = None) -> DataFrame:
    """``resumes(id, skills)`` to ``(resume_id, rank, job_id, score, matched, wanted)``.

    The ``top`` postings of each résumé by score, then listing order, as
    ``matching.deterministic`` ranks them; fewer if there are fewer postings.
    Null skills count as none. Résumés with a repeated id are rows of their own.

    Equal skill sets have equal scores, so sets meet, not rows: of each set of
    postings the first ``top`` of the listing are kept. Rounds go down the
    scores. A set of ``d`` skills that must share ``need`` of them is listed
    under its ``d - need + 1`` rarest, and a pair is made at its rarest common
    skill alone. A résumé that has ``top`` postings above the floor is done.
    """
    work = work or Work(jobs.sparkSession, "best")
    none = F.array().cast("array<string>")
    jobs = jobs.withColumn("skills", F.coalesce("skills", none))
    order = rarest_first(jobs, vocabulary)
    listing = [F.col(c) for c in matching.LISTED]
    job = F.struct(*matching.LISTED)
    sets = jobs.select(skill_bits(F.col("skills"), order).alias("bits"), F.size("skills").alias("wanted"), *matching.LISTED)
    first = sets.withColumn("_r", F.row_number().over(Window.partitionBy("bits", "wanted").orderBy(*listing))).where(F.col("_r") <= top)
    sets = work.save(first.groupBy("bits", "wanted").agg(F.collect_list(job).alias("jobs")), "sets")
    plain = sets.where("wanted = 0").select(F.explode("jobs").alias("job"), "bits", "wanted")
    heads = first.orderBy(*listing).limit(top).where("wanted > 0").select(job.alias("job"), "bits", "wanted")
    heads = work.save(plain.unionByName(heads).agg(F.collect_list(F.struct("bits", "wanted", "job")).alias("heads")), "heads")  # one row, at most 2 * top entries

    people = work.save(resumes.select("id", skill_bits(F.coalesce("skills", none), order).alias("mine")), "people")
    left = work.save(people.select("mine").distinct(), "open-0")
    found = None
    for turn, floor in enumerate(FLOORS):
        waiting = left.count()
        if not waiting:
            break
        last = turn == len(FLOORS) - 1
        pairs = _pairs(left, sets, floor, len(order), -(-waiting // BLOCK))
        met = pairs.select("mine", "bits", "wanted", F.explode("jobs").alias("job"))
        if last:  # postings without skills, and those without a shared one, in listing order
            alone = left.join(F.broadcast(heads)).select("mine", F.explode("heads").alias("h")).select("mine", "h.bits", "h.wanted", "h.job")
            met = met.unionByName(alone.where("bits & mine = 0"))
        matched = F.bit_count(F.col("bits").bitwiseAND(F.col("mine"))).cast("int")
        scored = met.select("mine", scoring.match_score(matched, F.col("wanted")).alias("score"), matched.alias("matched"), "wanted", "job")
        best = Window.partitionBy("mine").orderBy(F.desc("score"), *(F.col(f"job.{c}") for c in matching.LISTED))
        ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        rows = ranked.groupBy("mine").agg(F.collect_list(F.struct("rank", "job.id", "score", "matched", "wanted")).alias("best"))
        rows = work.save(rows if last else rows.where(F.size("best") == top), f"best-{turn}")
        found = rows if found is None else found.unionByName(rows)
        left = work.save(left.join(rows.select("mine"), "mine", "left_anti"), f"open-{turn + 1}") if not last else left
    if found is None:
        found = jobs.sparkSession.createDataFrame([], "mine long, best array<struct<rank: int, id: string, score: int, matched: int, wanted: int>>")
    # a skill set may be that of a third of all résumés
    salted = people.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = salted.join(found, ["mine", "_salt"]).select(F.col("id").alias("resume_id"), F.explode("best").alias("b"))
    return out.select("resume_id", "b.rank", F.col("b.id").alias("job_id"), "b.score", "b.matched", "b.wanted")


def _pairs(people: DataFrame, sets: DataFrame, floor: int, names: int, blocks: int) -> DataFrame:
    """Pairs of skill sets whose score is at least ``floor`` and that share a skill, once each."""
    # score >= floor means 160 * matched >= (2 * floor - 41) * wanted, since scores are rounded half up
    need = F.expr(f"cast(greatest(1, ({2 * floor - 41} * wanted + 159) div 160) as int)")
    of = lambda bits: F.filter(F.sequence(F.lit(0), F.lit(max(names - 1, 0))), lambda k: F.getbit(bits, k) == 1)
    long = F.bit_count("bits").cast("int")
    lists = sets.withColumn("need", need).where(long >= F.col("need"))
    lists = lists.withColumn("at", F.explode(F.slice(of(F.col("bits")), F.lit(1), long - F.col("need") + 1)))
    lists = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = people.withColumn("block", F.pmod(F.xxhash64("mine"), F.lit(blocks)).cast("int")).withColumn("at", F.explode(of(F.col("mine"))))
    common = F.col("bits").bitwiseAND(F.col("mine"))
    rarer = F.expr("(bits & mine) & (shiftleft(1L, at) - 1)")
    return asking.join(lists, ["block", "at"]).where((rarer == 0) & (F.bit_count(common) >= F.col("need"))).select("mine", "bits", "wanted", "jobs")


# --- the outside matcher --------------------------------------------------------


def _serve(calls: queue.SimpleQueue, answers: queue.SimpleQueue) -> None:
    while (call := calls.get()) is not None:
        try:
            answers.put((call(), None))
        except Exception as e:  # whatever the outside does is this request's failure only
            answers.put((None, f"{type(e).__name__}: {e}"))


class Caller:
    """Makes calls in a (daemon) thread of its own, one after another.

    A call out of time is left to its thread and counts as failed; the next one
    gets a new thread.
    """

    def __init__(self):
        self.calls: queue.SimpleQueue | None = None

    def answer(self, call: Callable[[], str], timeout: float) -> tuple[str | None, str | None]:
        if self.calls is None:
            self.calls, self.answers = queue.SimpleQueue(), queue.SimpleQueue()
            threading.Thread(target=_serve, args=(self.calls, self.answers), daemon=True).start()
        self.calls.put(call)
        try:
            return self.answers.get(timeout=timeout)
        except queue.Empty:
            self.close()
            return None, "timeout"

    def close(self) -> None:
        """The thread ends, if its call ever does."""
        if self.calls is not None:
            self.calls.put(None)
            self.calls = None


def patiently(call: Callable[[], str], attempts: int, timeout: float, pause: float, caller: Caller | None = None) -> tuple[str | None, int, str | None]:
    """``(answer, attempts, error)`` of a call that may fail or never return."""
    by, error = caller or Caller(), None
    try:
        for attempt in range(1, attempts + 1):
            text, error = by.answer(call, timeout)
            if text is not None:
                return text, attempt, None
            error = error or "no answer"
            if attempt < attempts:
                time.sleep(pause * 2 ** (attempt - 1))
        return None, attempts, error
    finally:
        if caller is None:
            by.close()


def asked(requests: DataFrame, ask: Callable[[dict], str], body: Callable[[dict], dict], at_once: int = 8, attempts: int = 3, timeout: float = 60.0, pause: float = 0.2) -> DataFrame:
    """``requests(_row, …)`` to ``(_row, text, attempts, error)``, ``at_once`` requests of a task at a time.

    ``body`` makes the payload of a row, ``ask`` posts it. The text is null after
    the last failed attempt, or if the answer has no ``matches``.
    """

    def one(row: dict, caller: Caller) -> tuple:
        def call() -> str:
            text = matching.output_text(ask(body(row)))
            if "matches" not in json.loads(text or "{}"):
                raise ValueError("empty answer")
            return text

        return (row["_row"], *patiently(call, attempts, timeout, pause, caller))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("_row", pa.int64()), ("text", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
        free: queue.SimpleQueue = queue.SimpleQueue()
        for _ in range(at_once):
            free.put(Caller())

        def served(row: dict) -> tuple:
            caller = free.get()
            try:
                return one(row, caller)
            finally:
                free.put(caller)

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 8 * at_once):
                    rows = list(pool.map(served, batch.slice(at, 8 * at_once).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
        for _ in range(at_once):
            free.get().close()

    return requests.mapInArrow(run, ASKED)


def match_each(resumes: DataFrame, jobs: DataFrame, ask: Callable[[dict], str], model: str = "", work: Work | None = None, **patience) -> DataFrame:
    """``resumes(id, text)`` to ``(resume_id, method, rank, job_id, score, matched, missing, summary)``.

    Each résumé is judged by the outside matcher on the first postings of the
    listing; answers on other postings go, scores are clamped. A résumé whose
    request fails gets its best postings by overlap instead, as many as the
    matcher would have been told. Null text counts as empty. Answers are stored
    before they are read, so no request goes out again for a later stage.
    Résumés are dealt to tasks by their number before anything slow.
    """
    work = work or Work(jobs.sparkSession, "asked")
    none = F.array().cast("array<string>")
    jobs = jobs.withColumn("skills", F.coalesce("skills", none))
    people = work.save(resumes.select("id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row")), "resumes")
    each = tables.dealt(people, "_row")
    told = [r.asDict(recursive=True) for r in matching.prompt_rows(jobs, "").collect()]  # at most fifteen
    scores = [scoring.match_score(F.size(F.array_intersect("skills", _texts(t["skills"]))), F.lit(len(t["skills"]))) for t in told]
    requests = each.withColumn("skills", skills.detect(F.col("text"))).select("_row", scoring.truncated(F.col("text"), matching.PROMPT_RESUME).alias("resume"), (F.array(*scores) if scores else F.array().cast("array<int>")).alias("scores"))

    def body(row: dict) -> dict:
        return matching.request([{**t, "baselineScore": s} for t, s in zip(told, row["scores"])], row["resume"], model)

    answers = work.save(asked(requests, ask, body, **patience), "answers")
    rows = people.select("_row", "id").join(answers.where("text is not null"), "_row")
    said = rows.select("_row", F.col("id").alias("resume_id"), F.posexplode(F.from_json("text", matching.ANSWER)["matches"]).alias("place", "m")).select("_row", "resume_id", "place", "m.*")
    place = F.create_map(*[F.lit(x) for n, t in enumerate(told) for x in (t["jobId"], n)]) if told else F.create_map().cast("map<string,int>")
    said = said.withColumn("listed", F.element_at(place, F.col("jobId"))).where("listed is not null")
    said = said.withColumn("score", scoring.clamp_score(F.coalesce("score", F.lit(0))))
    best = Window.partitionBy("_row").orderBy(F.desc("score"), "listed", "place")
    judged = said.select(
        "resume_id", F.lit(f"OPENAI:{model}").alias("method"), F.row_number().over(best).alias("rank"), F.col("jobId").alias("job_id"), "score",
        F.coalesce(F.size("matchedSkills"), F.lit(0)).alias("matched"), F.coalesce(F.size("missingSkills"), F.lit(0)).alias("missing"), F.coalesce("summary", F.lit("")).alias("summary"),
    )
    failed = each.join(answers.where("text is null").select("_row"), "_row", "left_semi")
    plain = best_matches(failed.select("id", skills.detect(F.col("text")).alias("skills")), jobs, matching.PROMPT_JOBS, work=Work(jobs.sparkSession, "fallback"))
    plain = plain.select("resume_id", F.lit("DETERMINISTIC").alias("method"), "rank", "job_id", "score", "matched", (F.col("wanted") - F.col("matched")).alias("missing"), scoring.match_summary(F.col("matched"), F.col("wanted")).alias("summary"))
    return judged.unionByName(plain)


def _texts(names: Sequence[str]) -> Column:
    return F.array(*(F.lit(n) for n in names)).cast("array<string>")
