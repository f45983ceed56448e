"""Many résumés against many postings, the outside matcher's tasks, and whole documents."""

import csv
import glob
import json
import random
import threading
import time

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import bulk_matching, matching
from lodestone.plans import documents

NAMES = [f"s{k}" for k in range(12)]
JOBS = "id string, title string, company string, location string, skills array<string>, experience string, description string, discovered_at timestamp"


def jobs(spark, rows):
    table = spark.createDataFrame([(i, t, "c", "l", s, "", None, None) for i, t, s in rows], JOBS)
    return table.withColumn("discovered_at", F.timestamp_seconds(F.length("title")))


def score(matched, wanted):
    return 35 if wanted == 0 else int(20 + 80 * matched / wanted + 0.5)


def brute(people, rows, top):
    out = []
    for person, own in people:
        scored = []
        for i, t, s in rows:
            s = s or []
            m = len(set(s) & set(own or []) & set(NAMES))
            scored.append((-score(m, len(s)), len(t), t, i, m, len(s)))
        out += [(person, r + 1, i, -neg, m, n) for r, (neg, _, _, i, m, n) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def told(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_matches_by_brute_force(spark, seed):
    """Random sets, hot skills, unknown skills, nulls, empties, and a repeated résumé."""
    rnd = random.Random(seed)
    some = lambda most, pool: rnd.sample(pool, rnd.randint(0, most))
    hot = NAMES[:2] * 10 + NAMES
    rows = [(f"j{k}", "t" * rnd.randint(1, 5), sorted({rnd.choice(hot) for _ in range(rnd.randint(0, 6))}) + some(1, ["unknown", "strange"])) for k in range(150)]
    rows += [("none", "t", None), ("twice", "tt", ["s3", "s3", "s4"])]
    people = [(k, some(7, NAMES)) for k in range(40)] + [(40, None), (41, []), (42, ["unknown"]), (43, ["s0"]), (43, ["s0", "s11"])]
    table = spark.createDataFrame(people, "id long, skills array<string>")
    for top in (1, 10):
        assert told(bulk_matching.best_matches(table, jobs(spark, rows), top, NAMES)) == brute(people, rows, top)


def test_fewer_postings_than_asked_for(spark):
    people = [(1, ["s1"]), (2, [])]
    rows = [("a", "t", ["s1"]), ("b", "t", []), ("c", "t", ["s2"])]
    table = spark.createDataFrame(people, "id long, skills array<string>")
    assert told(bulk_matching.best_matches(table, jobs(spark, rows), 10, NAMES)) == brute(people, rows, 10)
    assert told(bulk_matching.best_matches(table, jobs(spark, rows).limit(0), 10, NAMES)) == []
    assert told(bulk_matching.best_matches(table.limit(0), jobs(spark, rows), 10, NAMES)) == []


def test_a_common_skill_makes_few_pairs(spark):
    """Sets meet, not rows: copies of a set don't add pairs."""
    rows = [(f"j{k}", "t", ["s0", NAMES[k % 4 + 1]]) for k in range(400)]
    table = spark.createDataFrame([(k, ["s0", NAMES[k % 3 + 1]]) for k in range(300)], "id long, skills array<string>")
    order = bulk_matching.rarest_first(jobs(spark, rows), NAMES)
    sets = jobs(spark, rows).select(bulk_matching.skill_bits(F.col("skills"), order).alias("bits"), F.size("skills").alias("wanted")).distinct().withColumn("jobs", F.lit(0))
    mine = table.select(bulk_matching.skill_bits(F.col("skills"), order).alias("mine")).distinct()
    assert bulk_matching._pairs(mine, sets, 100, len(order), 2).count() == 3
    assert bulk_matching._pairs(mine, sets, 0, len(order), 2).count() == 12


def test_too_many_skills():
    with pytest.raises(ValueError):
        bulk_matching.skill_bits(F, [str(k) for k in range(64)])


def test_patience():
    calls = []

    def late():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "x"

    assert bulk_matching.patiently(late, 3, 1, 0) == ("x", 3, None)
    calls.clear()
    assert bulk_matching.patiently(late, 2, 1, 0) == (None, 2, "OSError: busy")
    began = time.time()
    assert bulk_matching.patiently(lambda: time.sleep(30), 2, 0.1, 0) == (None, 2, "timeout")
    assert time.time() - began < 5


def test_match_each_falls_back_row_by_row(spark):
    """A failure of one request is that résumé's alone; scores are clamped; strangers go."""
    rows = [(f"j{k}", "t" * (k + 1), ["Java", "Kafka"][: k % 3]) for k in range(20)]
    texts = spark.createDataFrame([(1, "I know Java"), (2, "please fail, Java"), (3, None)], "id long, text string")

    def ask(body):
        asked = json.loads(body["input"].split("\n", 1)[1])
        if "fail" in asked["resume"]:
            raise OSError("down")
        assert len(asked["jobs"]) == matching.PROMPT_JOBS
        found = [{"jobId": "j1", "score": 900, "matchedSkills": ["Java"], "missingSkills": [], "summary": "s"}, {"jobId": "stranger", "score": 1}, {"jobId": "j0", "score": None}]
        return json.dumps({"output": [{"content": [{"type": "output_text", "text": json.dumps({"matches": found})}]}]})

    out = bulk_matching.match_each(texts, jobs(spark, rows), ask, "m", attempts=2, pause=0.0)
    got = {k: [tuple(r)[1:] for r in sorted(out.collect(), key=lambda r: r["rank"]) if r["resume_id"] == k] for k in (1, 2, 3)}
    assert got[1] == got[3] == [("OPENAI:m", 1, "j1", 100, 1, 0, "s"), ("OPENAI:m", 2, "j0", 0, 0, 0, "")]
    assert len(got[2]) == 15 and got[2][0][:4] == ("DETERMINISTIC", 1, "j1", 100)
    assert out.where("resume_id = 2 and rank = 15").first()["score"] == 35


def test_match_each_deals_a_single_partition_to_tasks(spark):
    texts = spark.range(4_001).coalesce(1).select("id", F.lit("Java").alias("text"))

    def ask(body):
        found = [{"jobId": "j0", "score": 1, "matchedSkills": [], "missingSkills": [], "summary": str(TaskContext.get().partitionId())}]
        return json.dumps({"output": [{"content": [{"type": "output_text", "text": json.dumps({"matches": found})}]}]})

    out = bulk_matching.match_each(texts, jobs(spark, [("j0", "t", ["Java"])]), ask, "m", pause=0.0)
    assert out.count() == out.select("resume_id").distinct().count() == 4_001
    assert out.select("summary").distinct().count() == 3


def test_a_caller_keeps_its_thread_until_a_call_is_late():
    caller, seen = bulk_matching.Caller(), []

    def call():
        seen.append(threading.get_ident())
        if len(seen) == 2:
            raise OSError("busy")
        if len(seen) == 3:
            time.sleep(2)
        return "x"

    assert [bulk_matching.patiently(call, 1, 0.5, 0, caller) for _ in range(4)] == [("x", 1, None), (None, 1, "OSError: busy"), (None, 1, "timeout"), ("x", 1, None)]
    assert seen[0] == seen[1] == seen[2] != seen[3]
    caller.close()


def postings(spark, n):
    return catalog.order_postings(spark, "/root/testdata/sf0.001").limit(n)


def joined(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*"))).decode()


def test_documents_over_several_files(spark, tmp_path):
    want = [r["id"] for r in postings(spark, 100).orderBy(*documents.ORDER).collect()]
    for kind in ("json", "csv"):
        assert documents.write_document(postings(spark, 100), f"file://{tmp_path}/{kind}", kind, rows_a_part=30) == 100
        assert len(glob.glob(f"{tmp_path}/{kind}/part-*")) > 1
    assert [r["id"] for r in json.loads(joined(f"{tmp_path}/json"))] == want
    text = joined(f"{tmp_path}/csv")
    assert text.endswith("\r\n") and text.count("\r\n") == 101
    rows = list(csv.reader(text.splitlines()))
    assert rows[0][0] == "title" and [r[6].rsplit("/", 1)[1] for r in rows[1:]] == want


def test_parts_are_even_and_lines_are_numbered_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/csv"
    documents.write_document(postings(spark, 100), path, "csv", rows_a_part=30)
    sizes = [open(p, "rb").read().count(b"\r\n") for p in sorted(glob.glob(f"{tmp_path}/csv/part-*"))]
    assert sizes == [31, 30, 30, 10]
    lines = documents.document_lines(spark, path)
    assert "rangepartitioning" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [r["line"] for r in sorted(lines.collect())] == joined(f"{tmp_path}/csv").split("\r\n")[:-1]


def test_lines_of_one_file_in_many_pieces(spark, tmp_path):
    (tmp_path / "part-00000.txt").write_bytes(b"".join(b"line %d\r\n" % k for k in range(1, 20_001)))
    (tmp_path / "part-00001.txt").write_bytes(b"line 20001\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = documents.document_lines(spark, f"file://{tmp_path}")
        assert got.count() == 20_001 and got.where("line != concat('line ', number)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents_of_nothing_and_of_one(spark, tmp_path):
    for n in (0, 1):
        assert documents.write_document(postings(spark, n), f"file://{tmp_path}/json{n}", "json") == n
        assert len(json.loads(joined(f"{tmp_path}/json{n}"))) == n
        documents.write_document(postings(spark, n), f"file://{tmp_path}/csv{n}", "csv")
        assert joined(f"{tmp_path}/csv{n}").count("\r\n") == n + 1
    with pytest.raises(ValueError):
        documents.write_document(postings(spark, 1), f"file://{tmp_path}/x", "xml")


def test_a_failed_write_leaves_no_document(spark, tmp_path):
    broken = postings(spark, 100).withColumn("source_url", F.when(F.col("id") == F.lit("7"), F.raise_error(F.lit("broken"))).otherwise(F.col("source_url")))
    with pytest.raises(Exception, match="broken"):
        documents.write_document(broken, f"file://{tmp_path}/out", "json", rows_a_part=10)
    assert not glob.glob(f"{tmp_path}/out/part-*") and not glob.glob(f"{tmp_path}/out/_SUCCESS")
