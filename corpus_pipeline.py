"""The corpus pipeline: quality, exact copies, near copies, benchmark, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return rows of ``documents`` with all their
columns. Row-wise decisions are filters on the scan. Decisions about groups
are keyed by text or by a row number that is written first, never by doc_id,
so rows with a null or repeated doc_id take part like any other; key tables
are broadcast only while they are small.

Defined results: a null or empty text is scored as a text without words, and
stays or goes by that score; equal texts (null like empty) keep one row, of
equal ids any; a null doc_id loses against any other; an empty table gives an
empty result; clashing columns come through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, exact_dedup, ngram_join, packing, quality
from lodestone.llm.common import Scratch, dropped_after, maybe_broadcast, table, unique_join
from lodestone.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    score = quality.scorer(quality.fit(docs, table(spark, sf_dir, "labels"), quality.may_learn()))
    return docs.where(score(docs["text"].cast("string")) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the largest doc_id, a null one last."""
    scratch = Scratch(spark, "pipe-exact")
    found = scratch.save(exact_dedup.exact_duplicates(docs).where("group_size > 1").select(F.col("text_sha256").alias("sha"), "keep_id", "kept"), "found")
    groups = found.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.count_if("kept").alias("keeping"), F.count("*").alias("size"))
    groups = scratch.save(groups, "groups")
    norm = exact_dedup.normalised(F.col("text"))
    rows = docs.select(F.struct("*").alias("doc"), F.sha2(norm, 256).alias("sha"))
    mine = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("keep_id"))
    once = F.col("keeping").isNull() | ((F.col("keeping") == 1) & mine)
    kept = unique_join(rows, groups, "sha", "size", found.count(), groups.count(), how="left").where(once).select("doc.*")
    # several rows of a group have the id that stays: one of them, combined on the map side
    several = groups.where("keeping > 1")
    tied = unique_join(rows, several, "sha", "size", found.count(), several.count()).where(mine)
    best = tied.groupBy("sha").agg(F.max_by("doc", F.struct(F.col("doc.text").cast("string"))).alias("doc"))
    return kept.unionByName(best.select("doc.*")) if not several.isEmpty() else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, one row: that with the least doc_id, a null one last."""
    scratch = Scratch(spark, "pipe-near")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    found = ngram_join.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    groups = found.where("n_copies > 1 or n_links > 0").select(F.col("doc_id").alias("row"), "component_id")
    groups = scratch.save(groups.join(rows.select("row", F.col("doc.doc_id").cast("long").alias("id")), "row"), "groups")
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    gone = groups.join(best.select("best.row"), "row", "left_anti").select("row")
    gone = maybe_broadcast(scratch.save(gone, "gone"))
    return rows.join(gone, "row", "left_anti").select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    hit = decontam.detector(table(spark, sf_dir, "benchmark"))
    return docs.where(~hit(docs["text"].cast("string")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into windows of 2048 tokens."""
    return packing.pieces_digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again.

    What a stage and its operators wrote goes when the next result is there.
    """
    results = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with dropped_after():
            docs = results.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            results.drop(f"stage-{k - 1}")
    return docs


#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
