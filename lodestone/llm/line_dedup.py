"""Near-duplicate lines: an exact set-similarity join, later matches removed.

A line's tokens are its distinct runs of five words (all of a shorter line),
A-Z lower-cased, words cut at white space. Tokens are ordered by rarity; a
line posts its rarest ones (prefix filter); lines whose sizes or positions
rule out the similarity are not compared (length and positional filters, see
``setjoin.first_matches``); what remains is verified by the exact Jaccard
similarity.

A line goes if an earlier one - in the order (doc_id, line number) - has at
least ``percent`` of Jaccard similarity to it, whether or not that one stays.
So the result doesn't depend on the order of work.

Defined results: a null text has no line and stays null; lines are cut at
``\\n``; blank lines stay; equal lines match; repeated (doc_id, text) rows
count as the same lines and stay or go alike; rows of one doc_id with other
texts are documents of their own (a hash of the text goes with the id, and
breaks ties of the order); rows with a null doc_id keep all their lines; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm import setjoin as sj
from lodestone.llm.common import Scratch, bounded_broadcast, byte_texts, even_join, ship, shuffle_width, small_batches, tidy

SHARE = 8
CHUNK_LINES = 8_000
MAX_GONE_TEXTS, MAX_GONE_LINES = 300_000, 1_000_000  # bounds of a broadcast
CHUNK_BYTES = 2 << 20
U16, U48 = np.uint64(16), np.uint64(48)


class Lines:
    """The token sets of up to 2**16 lines at once.

    ``n`` and ``sid``: number of distinct tokens and identity of each line's
    set, from full 64-bit hashes (0 for a blank line). ``packed``: distinct
    tokens as ``line << 48 | the token's upper 48 bits``, sorted, for counts
    and postings, where a collision only makes the filter coarser.
    """

    def __init__(self, lines: list[bytes], words: int):
        w, places = sj.word_hashes(b"\n".join(lines).lower())
        total, some = len(w), len(lines)
        size = np.fromiter(map(len, lines), np.int64, some) + 1
        line = np.searchsorted(np.cumsum(size), places, side="right")
        length = np.bincount(line, minlength=some).astype(np.int64)
        start = np.cumsum(length) - length
        self.runs, self.runs_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if total >= words:
            runs = w[: total - words + 1].copy()
            for i in range(1, words):
                runs *= sj.K1
                runs += w[i : total - words + 1 + i]
            whole = line[: len(runs)] == line[words - 1 :]  # the run stays within its line
            self.runs, self.runs_of = sj.mix(runs[whole]), line[: len(runs)][whole]
        self.short = np.flatnonzero((length < words) & (length > 0))  # a shorter line is one token
        acc = length[self.short].astype(np.uint64)
        for i in range(words - 1 if len(self.short) else 0):
            more = length[self.short] > i
            acc[more] = acc[more] * sj.K1 + w[start[self.short[more]] + i]
        self.short_h = sj.mix(acc)
        packed = np.sort((np.r_[self.runs_of, self.short].astype(np.uint64) << U48) | (np.r_[self.runs, self.short_h] >> U16))
        fresh = np.r_[True, packed[1:] != packed[:-1]] if len(packed) else np.zeros(0, bool)
        self.packed = packed[fresh]
        self.of = (self.packed >> U48).astype(np.int64)
        self.cuts = np.searchsorted(self.runs_of, np.arange(some + 1))
        self.n = np.diff(self.cuts)
        self.n[self.short] = 1
        # a sum of mixed tokens tells sets apart; the size is mixed in
        sums = np.zeros(some, np.uint64)
        long = np.flatnonzero(np.diff(self.cuts))
        if len(long):
            sums[long] = np.add.reduceat(sj.mix(self.runs ^ sj.K2), self.cuts[long])
        sums[self.short] = sj.mix(self.short_h ^ sj.K2)
        for k in np.unique((packed[~fresh] >> U48).astype(np.int64)).tolist():  # repeated tokens count once
            own = np.unique(self.runs[self.cuts[k] : self.cuts[k + 1]])
            self.n[k], sums[k] = len(own), np.add.reduce(sj.mix(own ^ sj.K2))
        self.sid = np.where(self.n > 0, sj.mix(sums + self.n.astype(np.uint64) * sj.K1) | np.uint64(1), np.uint64(0))

    def hashes(self) -> np.ndarray:
        """Distinct tokens by line, as hashes whose lowest 16 bits are 0."""
        return self.packed << U16

    def tokens(self, codes: np.ndarray) -> list[np.ndarray]:
        """Full token hashes of every line, distinct, rarest first."""
        h, of = np.r_[self.runs, self.short_h], np.r_[self.runs_of, self.short]
        order = np.lexsort((h, sj.codes_of(h, codes), of))
        h, of = h[order], of[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
        h, of = h[fresh], of[fresh]
        cuts = np.searchsorted(of, np.arange(len(self.n) + 1)).tolist()
        return [h[a:b] for a, b in zip(cuts, cuts[1:])]

    def rarest(self, codes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Posted tokens, rarest first: keys (6 bits of code, then hash) and lines."""
        keys = sj.ordered_keys(self.hashes(), codes)
        by_line = np.sort((self.of.astype(np.uint64) << U48) | (keys >> U16))
        most = np.minimum(self.n, self.n - sj.needed(self.n, percent) + 1 + self.n // SHARE)
        at = np.searchsorted(self.of, np.arange(len(self.n)))
        keep = np.arange(len(keys)) - at[self.of] < most[self.of]
        return by_line[keep] << U16, self.of[keep]


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """``(row, line number, line)`` lists, bounded in lines and bytes."""
    rows, numbers, lines, size = [], [], [], 0
    for r, t in enumerate(texts):
        for k, line in enumerate(t.split(b"\n")):
            if len(lines) >= CHUNK_LINES or (lines and size + len(line) > CHUNK_BYTES):
                yield rows, numbers, lines
                rows, numbers, lines, size = [], [], [], 0
            rows.append(r)
            numbers.append(k)
            lines.append(line)
            size += len(line)
    if lines:
        yield rows, numbers, lines


def removed_lines(docs: DataFrame, percent: int = 75, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, text_hash, lines array<int>)``: the line numbers that go, if any."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "lines")
    rows = keyed(docs).where("doc_id is not null and text is not null")
    names = ["doc_id", "text_hash", "line", "n", "sid", "slice", "counts"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sj.Counter()
        for b in small_batches(batches):
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for of, number, lines in _chunks(byte_texts(b.column(2))):
                got = Lines(lines, words)
                counter.add(got.hashes())
                some = np.flatnonzero(got.n > 0)
                none = pa.nulls(len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[np.array(of)[some]]), pa.array(keys[np.array(of)[some]]), pa.array(np.array(number)[some].astype(np.int32)), pa.array(got.n[some].astype(np.int32)), pa.array(got.sid[some].view(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())],
                    names,
                )
        slices = counter.slices()
        none = pa.nulls(len(slices))
        yield pa.RecordBatch.from_arrays([*[none.cast(pa.int64())] * 2, *[none.cast(pa.int32())] * 2, none.cast(pa.int64()), pa.array([k for k, _ in slices], pa.int32()), pa.array([c for _, c in slices], pa.binary())], names)

    both = scratch.save(rows.mapInArrow(tidy(measure), "doc_id long, text_hash long, line int, n int, sid long, slice int, counts binary"), "rows")
    coded = both.where("slice is null").select("doc_id", "text_hash", "line", "n", "sid")
    codes, hot = sj.rarity_codes(both.where("slice is not null"))
    shared_codes = spark.sparkContext.broadcast(codes)

    first = F.min(F.struct("doc_id", "line", "text_hash"))
    classes = scratch.save(coded.groupBy("sid").agg(F.first("n").alias("n"), first.alias("first"), F.count("*").alias("copies")), "classes")
    n_postings = int(classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + F.col("n") / SHARE + 2)).first()[0] or 0)
    n_buckets = sj.bucket_count(n_postings, shuffle_width(spark))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, dealer = shared_codes.value, sj.Dealer(n_buckets, hot)
        seen: set[int] = set()
        for b in small_batches(batches):
            for _, _, lines in _chunks(byte_texts(b.column(0))):
                got = Lines(lines, words)
                keys, of = got.rarest(table, percent)
                ids = got.sid.tolist()
                new = np.fromiter((i not in seen for i in ids), bool, len(ids))  # copies within a task post once
                seen.update(ids)
                if len(seen) > 1_000_000:
                    seen.clear()
                keep = new[of]
                yield from dealer.add(keys[keep], got.sid[of[keep]])
        yield from dealer.flush()

    dealt = rows.select("text").mapInArrow(tidy(deal), "bucket int, postings binary")
    lists = scratch.save(sj.shared_lists(dealt, n_postings), "lists")
    routed = sj.route(lists, classes, percent, SHARE, scratch)
    members = scratch.save(sj.places(routed).join(classes, "sid").select("sid", "places", "first"), "members")
    scratch.drop("lists", "hot", "visits", "units")

    wanted = members.select("first.doc_id", "first.text_hash", "first.line")
    n_members = wanted.count()
    bits = spark.sparkContext.broadcast(bloom.bit_table(wanted, n_members))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of the lines that the filter lets through; few others are among them."""
        table, filter_bits = shared_codes.value, bits.value
        for b in small_batches(batches):
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = byte_texts(b.column(2))
            n = np.array([t.count(b"\n") + 1 for t in texts])
            of = np.repeat(np.arange(len(texts)), n)
            number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            hit = bloom.contains(filter_bits, bloom.line_keys(ids[of], keys[of], number))
            of, number = of[hit], number[hit]
            split = {k: texts[k].split(b"\n") for k in np.unique(of).tolist()}  # only texts with such a line
            lines = [split[k][x] for k, x in zip(of.tolist(), number.tolist())]
            for lo in range(0, len(lines), CHUNK_LINES):
                some = slice(lo, lo + CHUNK_LINES)
                got = Lines(lines[some], words)
                tokens = pa.array([t.tobytes() for t in got.tokens(table)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.sid.view(np.int64)), pa.array(ids[of[some]]), pa.array(keys[of[some]]), pa.array(number[some].astype(np.int32)), tokens],
                    ["sid", "doc_id", "text_hash", "line", "tokens"],
                )

    found = rows.mapInArrow(tidy(gather), "sid long, doc_id long, text_hash long, line int, tokens binary")
    known = members.select("sid", "places", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"), F.col("first.line").alias("l"))
    exact = (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("line") == F.col("l"))
    sets = found.join(bounded_broadcast(known, "places"), "sid").where(exact).select("sid", "doc_id", "line", "text_hash", "places", "tokens")

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (meeting, block or own number, sid, doc_id, line, text_hash, tokens), of several meetings
        size = 0

        def search() -> pa.RecordBatch:
            sets = [np.frombuffer(h[6], "<u8") for h in held]
            gone = sj.first_matches(sets, percent, np.array([h[0] for h in held]), np.array([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([held[q][2] for q in gone], pa.int64())], ["sid"])

        for number, ((_, i, j), met) in enumerate(sj.grouped(batches, 3)):
            met = sorted({h[1]: h for h in met}.values(), key=lambda h: (h[2], h[3], h[4]))
            if len(met) > 1:
                held += [(number, h[0] if i != j else k, *h[1:]) for k, h in enumerate(met)]
                size += sum(len(h[5]) for h in met)
                if len(held) > 4 * sj.BLOCK_SETS or size > 8 * sj.BLOCK_TOKENS:
                    yield search()
                    held, size = [], 0
        if held:
            yield search()

    met = sj.meetings(sets).select("unit", "i", "j", "block", "sid", "doc_id", "line", "text_hash", "tokens")
    gone = scratch.save(met.mapInArrow(tidy(later), "sid long").distinct(), "gone")

    flagged = classes.join(gone.withColumn("all", F.lit(True)), "sid", "left").where("copies > 1 or all")
    flagged = scratch.save(flagged.select("sid", "first", "copies", F.coalesce("all", F.lit(False)).alias("all")), "flagged")
    scratch.drop("members", "gone")
    n_lines = classes.agg(F.sum("copies")).first()[0] or 0
    scratch.drop("classes")
    hits = even_join(coded, flagged, "sid", "copies", n_lines).where(F.col("all") | (F.struct("doc_id", "line", "text_hash") != F.col("first")))
    return hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, text)``: rows with one id are told apart by text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _maybe_touched(gone: DataFrame, n: int) -> Column:
    """Whether a text may lose lines, for rows with ``doc_id`` and ``text_hash``."""
    bits = gone.sparkSession.sparkContext.broadcast(bloom.bit_table(gone.select("doc_id", "text_hash", F.lit(0).alias("line")), n))

    @F.arrow_udf("boolean")
    def touched(ids: pa.Array, keys: pa.Array) -> pa.Array:
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False) & pc.is_valid(keys).to_numpy(zero_copy_only=False)
        ids, keys = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (ids, keys))
        return pa.array(known & bloom.contains(bits.value, bloom.line_keys(ids, keys)), pa.bool_())

    return touched(F.col("doc_id"), F.col("text_hash"))


def dedup_lines(docs: DataFrame, percent: int = 75, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, text, n_lines, removed)``: texts without their later lines.

    ``removed``: the numbers of the lines that went, from 0.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    gone = scratch.save(removed_lines(docs, percent, words, scratch), "removed")
    rows = keyed(docs)
    n, elements = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    if n <= MAX_GONE_TEXTS and elements <= MAX_GONE_LINES:
        rows = rows.join(F.broadcast(gone), ["doc_id", "text_hash"], "left").select("doc_id", "text", "lines")
    else:  # only texts that lose a line are shuffled
        touched = _maybe_touched(gone, n)
        kept = rows.where(~touched).select("doc_id", "text", F.lit(None).cast("array<int>").alias("lines"))
        rows = kept.unionByName(rows.where(touched).join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts, n = [], []
            for text, lines in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n.append(0 if text is None else text.count("\n") + 1)
                if lines:
                    drop = set(lines)
                    text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in drop])
                texts.append(text)
            removed = pc.fill_null(b.column(2), pa.scalar([], b.column(2).type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), removed], ["doc_id", "text", "n_lines", "removed"])

    return rows.mapInArrow(tidy(cut), "doc_id long, text string, n_lines long, removed array<int>")


def digest(cleaned: DataFrame) -> DataFrame:
    """Counts and the digest of each cleaned text."""
    return cleaned.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )
