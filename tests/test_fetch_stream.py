"""The stream of requests: each asked once, over restarts and batches begun again."""

import glob
import os

from pyspark.sql import functions as F

from lodestone import fixtures as fx
from lodestone.sources import web
from lodestone.streaming import fetching


def noting(folder):
    """A fetch function that notes every request in a folder that all tasks see, and the list of its notes."""
    folder = str(folder)
    os.makedirs(folder)

    def fetch(url, attempt):
        open(f"{folder}/{url.rsplit('/', 1)[1]}-{attempt}-{os.urandom(4).hex()}", "w").close()
        if url.endswith("broken"):
            raise OSError("no route")
        return {"status": 200, "body": url}

    return fetch, lambda: sorted(n.rsplit("-", 1)[0] for n in os.listdir(folder))


def test_each_request_is_asked_once(spark, tmp_path):
    site, asked = noting(tmp_path / "asked")
    at = lambda name: f"file://{tmp_path}/{name}"

    def run(rows=(), lookup=fx.lookup):
        if rows:
            spark.createDataFrame(list(rows), fetching.REQUESTS).coalesce(1).write.mode("append").parquet(at("in"))
        query = fetching.fetch_stream(spark, at("in"), at("out"), at("state"), web.live_web(site), lookup)
        query.awaitTermination()
        return {(r["url"], r["attempt"]): r for r in fetching.fetched(spark, at("out")).collect()}

    u = "http://site.example/"
    got = run([(u + "a", 1), (u + "a", None), (u + "b", 1), (None, 1), (u + "broken", 1), ("http://127.0.0.1/x", 1), ("no-address", 1)])
    assert asked() == ["a-1", "b-1", "broken-1"]
    assert got[u + "a", 1]["status"] == 200 and got[u + "a", 1]["body"] == u + "a"
    assert got[u + "broken", 1]["error"] == "io"
    assert got["http://127.0.0.1/x", 1]["error"] == got["no-address", 1]["error"] == "unsafe"

    got = run([(u + "a", 1), (u + "b", 2), (u + "c", 1)])  # a is known, b is tried again
    assert asked() == ["a-1", "b-1", "b-2", "broken-1", "c-1"]
    assert len(got) == 7 and len({r["batch"] for r in got.values()}) == 2

    run()  # nothing new
    last = max(glob.glob(f"{tmp_path}/state/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)  # as if the driver was lost after the answers were stored
    for crc in glob.glob(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    assert len(run()) == 7
    assert asked() == ["a-1", "b-1", "b-2", "broken-1", "c-1"]


def test_names_are_looked_up_by_default(spark, tmp_path):
    site, asked = noting(tmp_path / "asked")
    spark.createDataFrame([("http://localhost/x", 1)], fetching.REQUESTS).write.parquet(f"file://{tmp_path}/in")
    fetching.fetch_stream(spark, *(f"file://{tmp_path}/{n}" for n in ("in", "out", "state")), web.live_web(site)).awaitTermination()
    row = fetching.fetched(spark, f"file://{tmp_path}/out").first()
    assert row["error"] == "unsafe" and asked() == []


def test_admission_by_files(spark, tmp_path):
    site, asked = noting(tmp_path / "asked")
    for k in range(5):
        spark.createDataFrame([(f"http://site.example/{k}", 1)], fetching.REQUESTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    fetching.fetch_stream(spark, *(f"file://{tmp_path}/{n}" for n in ("in", "out", "state")), web.live_web(site), fx.lookup, files=2).awaitTermination()
    sizes = fetching.fetched(spark, f"file://{tmp_path}/out").groupBy("batch").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == [1, 2, 2] and len(asked()) == 5
