"""Requests as a stream: fetched batch by batch, each once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import addresses
from lodestone.plans.work import Work
from lodestone.sources import web as webs

REQUESTS = "url string, attempt int"
FETCHED = f"{REQUESTS}, status int, content_type string, body string, location string, retry_after string, error string, batch long"
FILES_AT_ONCE = 16


def fetch_stream(
    spark: SparkSession, requests: str, out: str, checkpoint: str, web: webs.Web, lookup: addresses.Lookup | None = addresses.system_addresses,
    files: int = FILES_AT_ONCE, now: Callable[[], float] = time.time, whole: bool = True,
) -> StreamingQuery:
    """Fetches the ``(url, attempt)`` rows of Parquet files as they come into a folder.

    At most ``files`` files make a batch. A request that was seen before, in
    any batch or in this one, isn't asked again; what was seen is the stream's
    state, kept by RocksDB if the session says so. Hosts are looked up and
    checked as in a crawl (not with ``lookup`` null); a refused one is an
    ``unsafe`` error. A batch's answers are a folder of ``out`` with its number:
    one that is begun again after its answers were stored asks nobody. Null
    URLs are no requests; a null attempt is the first. ``whole``: stop when all
    files that are there are read.
    """
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files).parquet(requests)
    stream = stream.where("url is not null").withColumn("attempt", F.coalesce("attempt", F.lit(1))).dropDuplicates(["url", "attempt"])

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        folder = f"{out}/batch={number}"
        work = Work(session, "fetch")
        rows = work.save(batch, "requests")  # the state moves on with this, and once, also for answers that are there
        if _stored(session, folder):
            return work.drop()
        hosts = rows.withColumn("target", F.col("url"))
        gated = addresses.Addresses(work.save, lookup).gate(hosts, int(now() * 1e6)).drop("target") if lookup else rows.withColumns({"unsafe": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})
        gated = work.save(gated, "gated")
        refused = gated.where("unsafe is not null").select("url", "attempt", F.col("unsafe").alias("body"), F.lit("unsafe").alias("error"))
        asked = webs.answers(gated.where("unsafe is null").select("url", "attempt", "address"), web).drop("address")
        asked.unionByName(refused, allowMissingColumns=True).write.mode("overwrite").parquet(folder)
        work.drop()

    started = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if whole else started).start()


def _stored(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def fetched(spark: SparkSession, out: str) -> DataFrame:
    """The answers of all batches so far."""
    return spark.read.schema(FETCHED).option("basePath", out).parquet(out)
