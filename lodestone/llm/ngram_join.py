"""Near-duplicate documents by the Jaccard similarity of word shingles.

T-occurrence search: sets that can be similar meet in small units; there a
set's short inverted lists are merged by a heap and its long ones probed
(DivideSkip), see ``setjoin.route`` and ``setjoin.t_occurrence``. Nothing is
approximate: shingles are held as 64-bit hashes, and every pair that reaches
the threshold is counted once and ends in one component.

Defined results: a null or empty text, or one of white space, has an empty
set and is linked with nothing; fewer words than a shingle are one shingle;
equal sets are linked; repeated rows come back each; rows without a doc_id
come back with their size and a null component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm import setjoin as sj
from lodestone.llm.common import Scratch, bounded_broadcast, byte_texts, ship, shuffle_width, small_batches, tidy, unique_join
from lodestone.llm.components import connected_components

SHARE = 4  # a set posts a quarter of its tokens beyond the prefix


def text_tokens(text: bytes, words: int = 5) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included."""
    return sj.shingle_hashes(sj.word_hashes(text.lower())[0], words)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    h = text_tokens(text, words)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def set_id(s: np.ndarray) -> int:
    """Identity of a set: a signed 64-bit hash; 0 stands for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_copies, n_links)``, a row for each row.

    ``component_id``: the least doc_id reachable by links. ``n_copies``: rows
    with an equal set, itself included. ``n_links``: the other sets that are
    similar to the row's; each pair is verified in exactly one meeting, and
    only counts and tree edges are written.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "ngram")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sj.Counter()
        for b in small_batches(batches):
            sizes, ids = [], []
            for x in byte_texts(b.column(1)):  # one set at a time: a batch's sets together are large
                s = shingle_set(x, words)
                counter.add(s)
                sizes.append(len(s))
                ids.append(set_id(s))
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        got = counter.slices()
        none = pa.nulls(len(got), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k for k, _ in got], pa.int32()), pa.array([c for _, c in got], pa.binary())], names)

    names = ["doc_id", "n", "sid", "slice", "counts"]
    both = scratch.save(rows.mapInArrow(tidy(measure), "doc_id long, n long, sid long, slice int, counts binary"), "rows")
    coded = both.where("slice is null").select("doc_id", "n", "sid")
    codes, hot = sj.rarity_codes(both.where("slice is not null"))
    shared_codes = spark.sparkContext.broadcast(codes)

    classes = coded.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    n_postings = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + F.col("n") / SHARE + 2)).first()[0]
    n_postings = int(n_postings or 0)
    n_buckets = sj.bucket_count(n_postings, shuffle_width(spark))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, dealer = shared_codes.value, set(), sj.Dealer(n_buckets, hot)
        for b in small_batches(batches):
            for x in byte_texts(b.column(0)):
                s = shingle_set(x, words)
                i, n = set_id(s), len(s)
                if n and i not in seen:  # copies within a task post once
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(i)
                    keys = sj.ordered_keys(s, table)
                    keys.sort()
                    k = sj.posted(n, percent, SHARE)
                    yield from dealer.add(keys[:k], np.full(k, i, np.int64).view(np.uint64))
        yield from dealer.flush()

    dealt = rows.where("doc_id is not null").select("text").mapInArrow(tidy(deal), "bucket int, postings binary")
    lists = scratch.save(sj.shared_lists(dealt, n_postings), "lists")
    placed = sj.places(sj.route(lists, classes, percent, SHARE, scratch))
    members = scratch.save(placed.join(classes, "sid").select("doc_id", "sid", "places"), "members")
    scratch.drop("lists", "hot", "visits", "units")

    one = lambda x: F.lit(0).cast(x)
    bits = spark.sparkContext.broadcast(bloom.bit_table(members.select("doc_id", one("long").alias("text_hash"), one("int").alias("line")), members.count()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the documents that the filter lets through; few others are among them."""
        filter_bits = bits.value
        for b in small_batches(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hit = bloom.contains(filter_bits, bloom.line_keys(ids, np.zeros(len(ids), np.int64)))
            got = [shingle_set(x, words) for x in byte_texts(b.column(1).filter(pa.array(hit)))]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["sid", "tokens"])

    found = rows.where("doc_id is not null").mapInArrow(tidy(gather), "sid long, tokens binary")
    sets = found.join(bounded_broadcast(members.select("sid", "places"), "places"), "sid").select("sid", "places", "tokens")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (unit, i, j), held in sj.grouped(batches, 3):
            held = list({h[1]: h for h in held}.values())
            held.sort(key=lambda h: (len(h[3]), h[1]))
            arrays = [np.frombuffer(h[3], "<u8") for h in held]
            union, found, n_links = sj.Union(len(held)), [], np.zeros(len(held), np.int64)
            side = np.array([h[0] for h in held]) if i != j else None
            lower: dict[int, list[int]] = {}  # a pair belongs to the least unit that both sets visit
            for k, h in enumerate(held):
                for u in h[2]:
                    if u < unit:
                        lower.setdefault(u, []).append(k)

            def elsewhere(q: int, unit=unit, held=held, lower=lower) -> np.ndarray | None:
                got = [lower[u] for u in held[q][2] if u < unit and len(lower[u]) > 1]
                return np.concatenate(got) if got else None

            def partners(q: int, them: np.ndarray, union=union, found=found, n_links=n_links) -> None:
                n_links[q] += len(them)
                n_links[them] += 1
                roots, at = np.unique(union.root(them), return_index=True)
                own = union.root(np.array([q]))[0]
                for r in them[at[roots != own]].tolist():
                    union.join(q, r)
                    found.append((q, r))

            if len(held) > 1:
                sj.t_occurrence(arrays, percent, side, elsewhere, partners)
            tied = np.flatnonzero(n_links).tolist()
            a = [held[q][1] for q, _ in found] + [held[q][1] for q in tied]
            b = [held[r][1] for _, r in found] + [None] * len(tied)
            n = [None] * len(found) + n_links[tied].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    met = sj.meetings(sets.withColumn("units", F.col("places.unit"))).select("unit", "i", "j", "block", "sid", "units", "tokens")
    # tree edges (a, b), and for each set of a meeting its links there (a, n)
    verified = scratch.save(met.mapInArrow(tidy(link), "a long, b long, n long"), "links")
    links = verified.where("b is not null").select("a", "b")
    degree = verified.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("links"))

    tied = connected_components(links, scratch, "links").withColumnRenamed("id", "sid")
    rooted = classes.join(tied, "sid", "left").where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "sid"))
    rooted = scratch.save(rooted, "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets")), "least")
    n_sets = rooted.count()
    named = unique_join(rooted, least, "root", "sets", n_sets, least.count()).join(degree, "sid", "left")
    named = scratch.save(named.select("sid", "component_id", "copies", "links"), "named")
    n_rows = classes.agg(F.sum("copies")).first()[0] or 0
    scratch.drop("members", "links", "classes", "rooted", "least")
    out = unique_join(coded.select("doc_id", "n", "sid"), named, "sid", "copies", n_rows, n_sets, how="left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(1)).otherwise(F.coalesce("copies", F.lit(1))).cast("long").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
