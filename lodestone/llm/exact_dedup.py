"""Exact dedup by an extendible-hash index on shared files (native).

Everything here is DataFrame and SQL functions.

1. Every row becomes an index entry (doc_id, 64-bit hash, SHA-256) of its
   text after lower-casing A-Z; entries are written to the shared folder.
   Entries of one key (hash, SHA-256) are combined before they are dealt, so
   a text that a third of all rows share is one record.
2. The directory maps ranges of the hash to buckets. It starts as one bucket
   and doubles, bit by bit, wherever a bucket holds more than ``bucket_keys``
   keys, as deep as that takes; only prefixes that are still overfull are
   counted further, so the counts stay small at any depth. ``bucket_keys``
   rises with the number of keys so that there are some ``MOST_BUCKETS``
   buckets at most. The directory is a table beside the buckets.
3. Owner tasks hold key ranges (runs of buckets). Each writes its buckets as
   files of their own, keys in hash order: a bucket's records of equal hash
   are a chain. ``Index.lookup`` finds texts by the directory and reads only
   the buckets they lead to.
4. Chains of keys with several rows, read back from the buckets, get their
   texts: combined within each input partition, dealt by the directory to the
   same owners, and compared there byte by byte, so collisions stay apart.
5. Members take their group's result by (hash, SHA-256).

Defined results: null text counts as empty and equals it; of equal texts the
row with the largest doc_id stays; a repeated (doc_id, text) row counts each
time and all its rows with that doc_id are kept; rows with a null doc_id are
dropped rows of their group (kept only if all its ids are null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, even_join, shuffle_width

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_BITS, MORE_BITS, ALL_BITS = 12, 4, 63
BUCKET_KEYS = 50_000
MOST_BUCKETS = 8192
MAX_BROADCAST = 200_000
Bucket = tuple[int, int]  # depth, and the first that many bits


def normalised(text: Column) -> Column:
    """Text with A-Z, and nothing else, in lower case; null as empty.

    ``lower`` does that for texts of ASCII alone, and much faster.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))


def directory(counts: dict[int, int], bits: int, bucket_keys: int = BUCKET_KEYS, root: Bucket = (0, 0)) -> list[Bucket]:
    """Buckets below ``root``, split as far as ``bits`` more bits tell.

    ``counts``: keys by the next ``bits`` bits. A bucket that is overfull with
    all of them used is for the caller to count further.
    """
    full, open_buckets = [], [(0, 0)]
    while open_buckets:
        depth, prefix = open_buckets.pop()
        span = bits - depth
        keys = sum(counts.get(k, 0) for k in range(prefix << span, (prefix + 1) << span))
        if depth == bits or keys <= bucket_keys:
            full.append((depth, prefix))
        else:
            open_buckets += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    found = sorted(full, key=lambda b: b[1] << (bits - b[0]))
    return [(root[0] + d, (root[1] << d) + p) for d, p in found]


def place(h: Column) -> Column:
    """A hash as a number from 0 below 2**63, by which ranges are told."""
    return F.shiftrightunsigned(h, 1)


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(place(h), ALL_BITS - bits)


def split(keys: DataFrame, bucket_keys: int) -> list[Bucket]:
    """The directory of ``keys(h)``; no bucket is overfull that another bit could split."""
    counts = {r["p"]: r["n"] for r in keys.groupBy(prefix(F.col("h"), FIRST_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 2**FIRST_BITS rows
    size = max(bucket_keys, -(-sum(counts.values()) // MOST_BUCKETS))
    done, bits = [], FIRST_BITS
    now = directory(counts, bits, size)
    while True:
        over = [b for b in now if b[0] == bits and counts.get(b[1], 0) > size]
        done += [b for b in now if b not in set(over)]
        if not over or bits >= ALL_BITS:
            return sorted(done + (over if over else []), key=lambda b: b[1] << (ALL_BITS - b[0]))
        more = min(MORE_BITS, ALL_BITS - bits)
        few = keys.sparkSession.createDataFrame([(p,) for _, p in over], "p long")  # overfull prefixes, each with over ``size`` keys
        some = keys.withColumn("p", prefix(F.col("h"), bits)).join(F.broadcast(few), "p")
        counts = {r["q"]: r["n"] for r in some.groupBy(prefix(F.col("h"), bits + more).alias("q")).agg(F.count("*").alias("n")).collect()}  # 2**MORE_BITS rows for each
        now = [b for root in over for b in directory({k: counts.get((root[1] << more) + k, 0) for k in range(1 << more)}, more, size, root)]
        bits += more


@dataclass(frozen=True)
class Index:
    """Buckets on shared files, and their directory ``(bucket, owner, depth, first, last)``.

    Records: h, sha, keep_id (largest doc_id of the text), group_size.
    """

    root: str
    buckets: DataFrame
    directory: DataFrame
    owners: int

    def located(self, rows: DataFrame) -> DataFrame:
        """``rows(h, ...)`` with the ``bucket`` and ``owner`` of their hash."""
        entry = F.struct("first", "bucket", "owner")
        # a bucket deeper than the slots lies in one slot, a shallower one takes all of a run of them
        slots = F.sequence(F.shiftright("first", ALL_BITS - FIRST_BITS), F.shiftright("last", ALL_BITS - FIRST_BITS))
        by_slot = self.directory.withColumn("slot", F.explode(slots)).groupBy("slot").agg(F.array_sort(F.collect_list(entry)).alias("held"))
        met = rows.withColumn("slot", prefix(F.col("h"), FIRST_BITS)).join(F.broadcast(by_slot), "slot")  # at most 2**FIRST_BITS rows, and all buckets
        own = F.element_at(F.filter("held", lambda b: b["first"] <= place(F.col("h"))), -1)
        return met.withColumn("_own", own).withColumn("bucket", F.col("_own.bucket")).withColumn("owner", F.col("_own.owner")).drop("_own", "held", "slot")

    def lookup(self, texts: DataFrame) -> DataFrame:
        """``texts(text)`` with ``keep_id`` and ``group_size`` of the equal texts in the index; null if there are none.

        Buckets that no text leads to are not read.
        """
        norm = normalised(F.col("text"))
        asked = self.located(texts.withColumn("h", F.xxhash64(norm)).withColumn("sha", F.sha2(norm, 256))).drop("owner")
        wanted = asked.select("bucket").distinct().limit(MOST_BUCKETS + 1).collect()  # as many as there are buckets at most
        there = self.buckets.where(F.col("bucket").isin([r["bucket"] for r in wanted]))
        return asked.join(there, ["bucket", "h", "sha"], "left").drop("bucket", "h", "sha", "owner")


def index_entries(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, sha)`` of every row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    return text.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"))


def build_index(entries: DataFrame, scratch: Scratch, bucket_keys: int = BUCKET_KEYS) -> Index:
    """The index of ``entries(doc_id, h, sha)``."""
    spark = entries.sparkSession
    keys = scratch.save(entries.groupBy("h", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "keys")
    ranges = split(keys.select("h"), bucket_keys)
    owners = max(1, min(len(ranges), 8 * shuffle_width(spark)))
    rows = [(k, k * owners // len(ranges), depth, p << (ALL_BITS - depth), ((p + 1) << (ALL_BITS - depth)) - 1) for k, (depth, p) in enumerate(ranges)]
    table = scratch.save(spark.createDataFrame(rows, "bucket int, owner int, depth int, first long, last long"), "directory")
    index = Index(scratch.path("buckets"), keys, table, owners)
    dealt = index.located(keys).repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "h", "sha")
    dealt.drop("owner").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(index.root)
    scratch.drop("keys")
    return Index(index.root, spark.read.schema("h long, sha string, keep_id long, group_size long, bucket int").parquet(index.root), table, owners)


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    entries = scratch.save(index_entries(docs), "entries")
    index = build_index(entries, scratch, bucket_keys)

    chains = scratch.save(index.buckets.where("group_size > 1").groupBy("h").agg(F.sum("group_size").alias("n")), "chains")
    total, n_chains = entries.count(), chains.count()
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    again = again.join(F.broadcast(chains), "h") if n_chains <= MAX_BROADCAST else even_join(again, chains, "h", "n", total)
    most, many = F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    combined = again.groupBy(F.spark_partition_id().alias("part"), "h", "norm").agg(most, many)
    routed = index.located(combined).repartitionById(index.owners, F.col("owner"))
    # within an owner: by bucket and chain; the text is the last key, so its bytes are compared
    groups = routed.groupBy("owner", "bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = scratch.save(groups.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").where("group_size > 1"), "groups")

    found = entries.join(F.broadcast(groups), ["h", "sha"], "left") if n_chains <= MAX_BROADCAST else even_join(entries, groups, ["h", "sha"], "group_size", total, how="left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
