"""Exact set-similarity search over 64-bit token sets.

Used by the line dedup and the n-gram join. A set of ``n`` tokens must share
at least ``T = ceil(percent * n / 100)`` tokens with any similar set. The steps:

1. ``Counter`` / ``rarity_codes``: how often tokens occur, as one byte for each
   of a fixed number of hash buckets (the table never grows with the data).
2. Every set posts its rarest tokens: all but ``T - 1 - extra`` of them. Two
   similar sets have at least ``extra`` or so of the posted tokens in common
   (``least_shared``), so ``extra`` trades postings for a sharper filter.
   ``pack_postings`` deals them as bytes, by token bucket.
3. ``shared_lists`` keeps the inverted lists with two or more sets.
4. ``route``: every list has a unit, its least set; a set visits the units of
   its lists. Two sets of a list have that list's unit in common, so all
   similar pairs meet, and nothing is transitive: a unit holds neighbours of
   one set. Lists of near copies have nearly the same members and so the same
   unit; a set therefore visits few units, not one for each token. Sets and
   visits that can't lead to a similar pair go (see ``route``).
5. ``meetings``: a unit's sets meet in one task, or, if the unit is large, its
   blocks meet pairwise. There ``t_occurrence`` (DivideSkip) or
   ``first_matches`` (prefix and positional filters) does the search.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, maybe_broadcast, shuffle_width, tidy, unique_join

BUCKET_BITS = 20
SLICE = 1 << 14
SALT_POSTINGS = 32_768
LEAST_BLOCK = 256
BLOCKS = 16
BLOCK_SETS = 2048
BLOCK_TOKENS = 1_500_000
POSTINGS_PER_PARTITION = 1_000_000
DEAL_POSTINGS = 800_000
HITS = 1_000_000
PROBE_COST = 0.0085  # the weight of a probe in DivideSkip's choice of L
U64 = np.uint64
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * K2
    x = (x ^ (x >> U64(27))) * K3
    return x ^ (x >> U64(31))


# Hashing of words: a polynomial over a word's bytes, modulo 2**64.
SEGMENT = 1 << 20
BASE = 0xD1342543DE82EF95  # 5 modulo 8, so powers differ in their low bits
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = mix(np.arange(1, 257, dtype=U64) * K1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for reuse."""
    if len(_POWERS.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(n, x, U64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def _segment_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    space = SPACES[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    if not space[-1]:
        edge = np.r_[edge, len(a)]
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(max(len(a), SEGMENT))
    sums = BYTES[a]
    sums *= up[: len(a)]
    np.cumsum(sums, out=sums)
    h = sums[ends - 1]
    later = starts > 0
    h[later] -= sums[starts[later] - 1]
    h *= down[starts]
    return mix(h + (ends - starts).astype(U64) * K2), starts


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where they start.

    Words are cut at ASCII white space. The work goes by segments of 1 MB,
    cut at spaces, so memory doesn't follow the text's length.
    """
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = len(text)
        if end - at > SEGMENT:
            cut = max(text.rfind(b" ", at, at + SEGMENT), text.rfind(b"\n", at, at + SEGMENT))
            if cut <= at:  # no space: the segment grows to the next one
                found = [x for x in (text.find(b" ", at + SEGMENT), text.find(b"\n", at + SEGMENT)) if x >= 0]
                cut = min(found) if found else len(text) - 1
            end = cut + 1
        h, s = _segment_words(text[at:end] if at or end < len(text) else text)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return (hashes[0], starts[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(starts))


def shingle_hashes(w: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words; shorter texts are one run."""
    n = len(w)
    if n == 0:
        return w
    if n < size:
        h = U64(n)
        with np.errstate(over="ignore"):
            for x in w:
                h = h * K1 + x
        return mix(np.array([h], U64))
    h = w[: n - size + 1].copy()
    for i in range(1, size):
        h *= K1
        h += w[i : n - size + 1 + i]
    return mix(h)


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of ``n`` with any set that is similar to it."""
    return (percent * n + 99) // 100


def posted(n: int, percent: int, share: int) -> int:
    """Posted tokens of a set of ``n``, with ``extra = n // share``."""
    return min(n, n - int(needed(n, percent)) + 1 + n // share)


def least_shared(n: Column, share: int) -> Column:
    """Posted tokens that a set has in common with any similar set, at least.

    One less than ``extra``, which covers the rounding where sizes differ.
    """
    return F.greatest(F.lit(1), F.floor(n / share) - 1)


class Counter:
    """Token counts by hash bucket, for one task."""

    def __init__(self) -> None:
        self.total = np.zeros(1 << BUCKET_BITS, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, h: np.ndarray) -> None:
        self.held.append((h >> U64(64 - BUCKET_BITS)).astype(np.int64))
        self.size += len(h)
        if self.size > 500_000:
            self._fold()

    def _fold(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=len(self.total))
            self.held, self.size = [], 0

    def slices(self) -> list[tuple[int, bytes]]:
        self._fold()
        narrow = np.minimum(self.total, 0xFFFFFFFF).astype("<u4")
        return [(k // SLICE, narrow[k : k + SLICE].tobytes()) for k in range(0, len(narrow), SLICE)] if self.total.any() else []


def rarity_codes(slices: DataFrame) -> tuple[np.ndarray, int]:
    """``slices(slice int, counts binary)`` of all tasks to log-scaled counts.

    Slices are summed on the executors; the driver gets 1 byte for each of
    the 2**20 buckets. The second result is the least hot code: that of a
    bucket which holds far more than its share.
    """
    size = 1 << BUCKET_BITS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(c, "<u4").astype(np.int64)
                sums[k] = sums[k] + got if k in sums else got
        for k, s in sums.items():
            code = np.zeros(SLICE, np.uint8)
            some = s > 0
            code[some] = np.minimum(63, 1 + np.floor(2 * np.log2(s[some]))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([code.tobytes()], pa.binary()), pa.array([int(s.sum())], pa.int64())], ["slice", "codes", "total"])

    parts = slices.select("slice", "counts").repartition(min(size // SLICE, shuffle_width(slices.sparkSession)), "slice")
    codes, total = np.zeros(size, np.uint8), 0
    for r in parts.mapInArrow(merge, "slice int, codes binary, total long").collect():  # 64 rows of 16 KB
        codes[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["codes"], np.uint8)
        total += r["total"]
    hot = int(1 + np.floor(2 * np.log2(8 * total / size + 16384)))
    return codes, hot


def codes_of(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return codes[(h >> U64(64 - BUCKET_BITS)).astype(np.int64)]


def ordered_keys(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Tokens as numbers whose order is rarest first: 6 bits of code, then hash."""
    return (codes_of(h, codes).astype(U64) << U64(58)) | (h >> U64(6))


def pack_postings(keys: np.ndarray, ids: np.ndarray, n_buckets: int, hot: int) -> Iterator[tuple[int, bytes]]:
    """Postings (token, set) as bytes for each bucket that has any.

    Within a bucket 32 bits tell tokens apart (the lowest marks hot ones);
    tokens that still fall together only make the filter a little coarser. A
    hot token's postings are dealt by set to as many buckets as its count asks
    for.
    """
    with np.errstate(over="ignore"):
        mixed = mix(keys)
        at = mixed
        code = keys >> U64(58)
        salted = code >= U64(hot)
        if salted.any():
            salts = np.maximum(2, 2.0 ** (code.astype(np.float64) / 2) / SALT_POSTINGS).astype(U64)
            at = np.where(salted, mix(mixed + (mix(ids) % salts) + U64(1)), mixed)
    token = ((mixed >> U64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | salted.astype(np.uint32)
    bucket, order = by_value(at % U64(n_buckets))
    token, ids = token[order], ids[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
        yield int(bucket[lo]), packed(token[lo:hi], ids[lo:hi])


def by_value(small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**32, sorted, with the order that sorts them.

    Sorting ``number << 32 | place`` is much faster than an indirect sort.
    """
    both = np.sort((small.astype(U64) << U64(32)) | np.arange(len(small), dtype=U64))
    return (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)


def packed(token: np.ndarray, ids: np.ndarray) -> bytes:
    return ids.astype("<u8").tobytes() + token.astype("<u4").tobytes()


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and sets of several blobs."""
    sizes = [len(x) // 12 for x in blobs]
    ids = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in zip(blobs, sizes)])
    token = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in zip(blobs, sizes)])
    return token, ids


class Dealer:
    """Gathers the posted keys of sets and packs them, a few million at a time."""

    def __init__(self, n_buckets: int, hot: int):
        self.n_buckets, self.hot = n_buckets, hot
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.ids.append(ids)
        self.size += len(keys)
        if self.size >= DEAL_POSTINGS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            got = list(pack_postings(np.concatenate(self.keys), np.concatenate(self.ids), self.n_buckets, self.hot))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "postings"])
        self.keys, self.ids, self.size = [], [], 0


def shared_lists(dealt: DataFrame, n_postings: int) -> DataFrame:
    """Of ``dealt(bucket int, postings binary)``, the lists with several sets.

    One row for each bucket. A bucket is one task's work at a time; the
    numbers of buckets and partitions follow the number of postings, so a
    bucket's arrays stay small.
    """
    width = max(shuffle_width(dealt.sparkSession), -(-n_postings // POSTINGS_PER_PARTITION))

    def shared(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        token, ids = unpacked(blobs)
        value, order = by_value(token)
        token, ids = token[order], ids[order]
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        keep = np.repeat(several, np.diff(np.r_[starts, len(ids)])) | (token & 1).astype(bool)
        token, ids = token[keep], ids[keep]
        order = np.lexsort((ids, token))
        token, ids = token[order], ids[order]
        keep = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])] if len(ids) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(token[keep], ids[keep])], pa.binary())], ["bucket", "postings"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), held in grouped(batches, 1):
            yield shared(bucket, [x for (x,) in held])

    return dealt.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(lists), "bucket int, postings binary")


def _hot_units(lists: DataFrame) -> DataFrame:
    """``(bucket, hot array<struct(token, unit)>)``: units of salted tokens.

    A salted token's list lies in several buckets; its unit is the least set
    over all of them. One row for each bucket with such a token; the table is
    smaller than the postings by the count that makes a token hot.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                token, ids = unpacked([blob])
                hot = (token & 1).astype(bool)
                token, ids = token[hot], ids[hot]  # sorted by token, then set
                first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
                cols = [pa.array(np.full(len(first), bucket, np.int32)), pa.array(token[first].astype(np.int64)), pa.array(ids[first].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "token", "sid"])

    found = lists.mapInArrow(tidy(least), "bucket int, token long, sid long")
    tokens = found.groupBy("token").agg(F.min("sid").alias("unit"), F.collect_list("bucket").alias("buckets"))
    by_bucket = tokens.select(F.explode("buckets").alias("bucket"), F.struct("token", "unit").alias("hot"))
    return by_bucket.groupBy("bucket").agg(F.collect_list("hot").alias("hot"))


def route(lists: DataFrame, classes: DataFrame, percent: int, share: int, scratch: Scratch) -> DataFrame:
    """Visits ``(sid, unit, n_blocks, block)`` of the sets to units.

    ``lists``: ``shared_lists``; ``classes``: ``(sid, n)``. What goes, without
    loss of a similar pair:

    * a set with fewer than ``c = least_shared(n)`` posted tokens in shared
      lists (it has no similar set at all);
    * of a set's visits those with the fewest tokens, ``(c - 1) // 2`` tokens
      in all: the posted tokens that two similar sets have in common are more
      than both leave out together;
    * visits to units without another set of a size that could be similar.
    """

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, hot_units in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                token, ids = unpacked([blob])
                if not len(ids):
                    continue
                ids = ids.view(np.int64)
                first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                unit = np.minimum.reduceat(ids, first)
                if hot_units:
                    known = {h["token"]: h["unit"] for h in hot_units}
                    hot = np.flatnonzero(token[first] & 1)
                    unit[hot] = [known[t] for t in token[first][hot].tolist()]
                unit = np.repeat(unit, np.diff(np.r_[first, len(ids)]))
                order = np.lexsort((unit, ids))
                ids, unit = ids[order], unit[order]
                start = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (unit[1:] != unit[:-1])])
                tokens = np.diff(np.r_[start, len(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[start]), pa.array(unit[start]), pa.array(tokens)], ["sid", "unit", "c"])

    hot = scratch.save(_hot_units(lists), "hot")
    with_hot = lists.join(maybe_broadcast(hot, 100_000), "bucket", "left").select("postings", "hot")
    visits = with_hot.mapInArrow(tidy(units_of), "sid long, unit long, c long")
    visits = visits.repartition("sid").groupBy("sid", "unit").agg(F.sum("c").alias("c"))
    visits = visits.join(classes.select("sid", "n"), "sid")
    least = least_shared(F.col("n"), share)
    own = Window.partitionBy("sid")
    visits = visits.withColumn("total", F.sum("c").over(own)).where(F.col("total") >= least)
    visits = visits.withColumn("upto", F.sum("c").over(own.orderBy("c", "unit")))
    visits = visits.where(F.col("upto") > F.floor((least - 1) / 2))
    # sizes by a class whose neighbours alone can hold similar sizes
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent))).cast("int")
    visits = scratch.save(visits.select("sid", "unit", F.col("n").cast("int").alias("n"), step.alias("k")), "visits")
    sizes = visits.groupBy("unit", "k").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    sizes = sizes.groupBy("unit").agg(F.collect_list(F.struct("k", "sets")).alias("kinds"), F.sum("sets").alias("sets"), F.sum("tokens").alias("tokens")).where("sets > 1")
    block = F.least(F.greatest(F.ceil(F.col("sets") / BLOCKS), F.lit(LEAST_BLOCK)), F.lit(BLOCK_SETS))
    n_blocks = F.greatest(F.ceil(F.col("sets") / block), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    sizes = scratch.save(sizes.select("unit", "kinds", "sets", n_blocks.alias("n_blocks")), "units")
    met = unique_join(visits, sizes, "unit", "sets", visits.count(), sizes.count())
    close = F.aggregate(F.filter("kinds", lambda x: F.abs(x["k"] - F.col("k")) <= 1), F.lit(0).cast("long"), lambda a, x: a + x["sets"])
    met = met.where(close > 1)
    return met.select("sid", "unit", "n_blocks", F.pmod(F.xxhash64("sid", "unit"), F.col("n_blocks")).cast("int").alias("block"))


def bucket_count(n_postings: int, width: int) -> int:
    return 16 * max(width, -(-n_postings // POSTINGS_PER_PARTITION))


def places(routed: DataFrame) -> DataFrame:
    """``(sid, places)``: a set's visits as one list, at most one a posted token."""
    return routed.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("unit", "n_blocks", "block"))).alias("places"))


def meetings(sets: DataFrame) -> DataFrame:
    """Sets with ``places`` once for each meeting, dealt to the meetings' tasks.

    Meeting (i, j), i <= j, is that of two blocks of a unit. The meetings of a
    unit are numbered and go to tasks in turn, so they never pile up on one.
    """
    spark = sets.sparkSession
    width = shuffle_width(spark)
    each = sets.withColumn("place", F.explode("places")).select("*", "place.unit", "place.n_blocks", "place.block").drop("place")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
    )
    met = each.withColumn("m", F.explode(pairs)).select("*", "m.i", "m.j").drop("m")
    turn = F.pmod(F.xxhash64("unit"), F.lit(width)) + F.col("i").cast("long") * F.col("n_blocks") - F.floor(F.col("i") * (F.col("i") + 1) / 2) + F.col("j")
    return met.repartitionById(width, F.pmod(turn, F.lit(width)).cast("int")).sortWithinPartitions("unit", "i", "j")


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches, gathered by their first ``n_keys`` columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            key = row[:n_keys]
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row[n_keys:])
    if held:
        yield now, held


def merged(lists: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists with weights, merged to distinct numbers and summed weights.

    A heap holds the runs by length; the two shortest are merged, the result
    goes back, until one is left.
    """
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = numbers()
    heap = [(len(x), next(turn), x, np.full(len(x), w, np.int64)) for x, w in lists]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heap[0]
        x = np.concatenate([a, b])
        order = np.argsort(x, kind="stable")  # merges the two runs
        x, w = x[order], np.concatenate([wa, wb])[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        if len(first) < len(x):
            x, w = x[first], np.add.reduceat(w, first)
        heapq.heapreplace(heap, (len(x), next(turn), x, w))
    return heap[0][2], heap[0][3]


def t_occurrence(
    sets: list[np.ndarray],
    percent: int,
    side: np.ndarray | None,
    elsewhere: Callable[[int], np.ndarray | None],
    partners: Callable[[int, np.ndarray], None],
) -> None:
    """T-occurrence search (DivideSkip) of every set among those before it.

    ``sets``: sorted token arrays, ascending by size. ``side``: if given, only
    sets of another side count. ``elsewhere(q)``: sets that meet ``q`` in
    another task too and are left to it. ``partners(q, all)`` gets all sets
    before ``q`` that are similar to it.

    Tokens with the same sets have one inverted list, weighted by their
    number. A query's lists are ordered by length; the longest, up to ``L`` of
    weight, are set aside, with ``L = T / (PROBE_COST * log2(M) + 1)`` and
    ``M`` the longest list's length. The short ones are merged by a heap;
    a candidate needs a weight of ``T - L`` there, ``T`` taken with its own
    size, and is then probed in the long lists, longest last, until it has
    reached ``T`` or can't any more.
    """
    total = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(total), sizes)
    order = np.argsort(tokens, kind="stable")  # owners ascend within a token
    st, so = tokens[order], owner[order]
    first = np.flatnonzero(np.r_[True, st[1:] != st[:-1]])
    length = np.diff(np.r_[first, len(st)])
    with np.errstate(over="ignore"):  # lists with equal members, told by a sum of mixed numbers
        who = np.add.reduceat(mix((so.astype(U64) + U64(1)) * K1), first)
    some = np.flatnonzero(length > 1)
    _, at, weight = np.unique(who[some], return_index=True, return_counts=True)
    lists = [so[first[k] : first[k] + length[k]] for k in some[at].tolist()]
    if not lists:
        return
    list_len = length[some[at]]
    member = np.concatenate(lists)
    which = np.repeat(np.arange(len(lists)), list_len)
    rank = np.arange(len(member)) - np.repeat(np.cumsum(list_len) - list_len, list_len)
    order = np.lexsort((list_len[which], member))  # by set, its shortest lists first
    member, which, rank = member[order], which[order], rank[order]
    cuts = np.searchsorted(member, np.arange(total + 1))
    masks: dict[int, np.ndarray] = {}

    def probe(k: int, cand: np.ndarray) -> np.ndarray:
        """Which candidates a long list holds: binary search, or, for many, a mask."""
        x = lists[k]
        if len(cand) * 4 < len(x):
            return x[np.minimum(np.searchsorted(x, cand), len(x) - 1)] == cand
        if k not in masks:
            if len(masks) * total > 32 << 20:
                masks.clear()
            masks[k] = np.zeros(total, bool)
            masks[k][x] = True
        return masks[k][cand]

    for q in range(1, total):
        n = int(sizes[q])
        t = int(needed(n, percent))
        mine, before = which[cuts[q] : cuts[q + 1]], rank[cuts[q] : cuts[q + 1]]
        use = before > 0  # the list holds an earlier set
        mine, before = mine[use], before[use]
        w = weight[mine]
        if not len(mine) or int(w.sum()) < t:
            continue
        most = t / (PROBE_COST * np.log2(float(list_len[mine[-1]]) + 1) + 1)
        upto = np.cumsum(w[::-1])
        n_long = int(np.searchsorted(upto, min(most, t - 1), side="right"))
        n_short = len(mine) - n_long
        rest = int(upto[n_long - 1]) if n_long else 0
        cand, have = merged([(lists[k][:b], x) for k, b, x in zip(mine[:n_short].tolist(), before[:n_short].tolist(), w[:n_short].tolist())])
        want = -(-percent * (n + sizes[cand]) // (100 + percent))  # the overlap of similar sets of these sizes
        keep = (have + rest >= want) & (100 * sizes[cand] >= percent * n) & (100 * n >= percent * sizes[cand])
        if side is not None:
            keep &= side[cand] != side[q]
        cand, have, want = cand[keep], have[keep], want[keep]
        if len(cand) and (others := elsewhere(q)) is not None:
            keep = ~np.isin(cand, others)
            cand, have, want = cand[keep], have[keep], want[keep]
        for step, (k, x) in enumerate(zip(mine[n_short:].tolist(), w[n_short:].tolist())):
            if not len(cand):
                break
            have = have + x * probe(k, cand)
            rest -= x
            if step % 16 == 0:
                keep = have + rest >= want
                if not keep.all():
                    cand, have, want = cand[keep], have[keep], want[keep]
                elif (have >= want).all():
                    break
        found = cand[have >= want]
        if len(found):
            partners(q, found)


def first_matches(sets: list[np.ndarray], percent: int, group: np.ndarray, side: np.ndarray) -> list[int]:
    """Sets similar to any earlier set of their ``group`` and another ``side``.

    ``sets``: tokens in one global order, rarest first. Only prefixes are
    indexed, with positions. At the ``c``-th common prefix token, at positions
    ``i`` and ``j``, two sets can share ``c + min(n - i, m - j) - 1`` tokens
    at most (positional filter); this and their sizes must allow the
    similarity. Candidates are compared exactly, the likeliest first, until
    one is similar.
    """
    total = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    prefix = np.where(sizes > 0, sizes - needed(sizes, percent) + 1, 0)
    ends = np.cumsum(prefix)
    owner = np.repeat(np.arange(total), prefix)
    place = np.arange(len(owner)) - np.repeat(ends - prefix, prefix)
    tokens = np.concatenate([s[:p] for s, p in zip(sets, prefix.tolist())])
    with np.errstate(over="ignore"):  # lists of other groups are other lists
        tokens = mix(tokens ^ mix(group.astype(U64) * K1)[owner])
    order = np.argsort(tokens, kind="stable")
    st, so, sp = tokens[order], owner[order], place[order]
    fresh = np.r_[True, st[1:] != st[:-1]] if len(st) else np.zeros(0, bool)
    begin, many = np.empty(len(st), np.int64), np.empty(len(st), np.int64)
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    begin[order], many[order] = first, np.arange(len(st)) - first  # a token's postings of earlier sets
    upto = np.r_[0, np.cumsum(many)]
    gone: list[int] = []
    whole: dict[int, set] = {}

    def members(k: int) -> set:
        if k not in whole:
            whole[k] = set(sets[k].tolist())
        return whole[k]

    lo = 0
    while lo < len(owner):  # some queries at a time, so that their postings stay bounded
        last = owner[max(lo, int(np.searchsorted(upto, upto[lo] + HITS, side="right")) - 2)]
        hi = int(ends[last])
        n_hits = int(upto[hi] - upto[lo])
        c = many[lo:hi]
        at = np.repeat(begin[lo:hi] - (upto[lo:hi] - upto[lo]), c) + np.arange(n_hits)
        q, i, cand, j = np.repeat(owner[lo:hi], c), np.repeat(place[lo:hi], c), so[at], sp[at]
        n, m = sizes[q], sizes[cand]
        keep = (100 * m >= percent * n) & (100 * n >= percent * m) & (side[cand] != side[q])
        q, i, cand, j, n, m = (x[keep] for x in (q, i, cand, j, n, m))
        lo = hi
        if not len(q):
            continue
        pair = q * total + cand
        by = np.argsort(pair, kind="stable")  # i ascends within a pair
        pair, q, i, cand, j, n, m = (x[by] for x in (pair, q, i, cand, j, n, m))
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        hits = np.diff(np.r_[start, len(pair)])
        c = np.arange(len(pair)) - np.repeat(start, hits)
        want = -(-percent * (n + m) // (100 + percent))
        fits = np.logical_and.reduceat(c + np.minimum(n - i, m - j) >= want, start)
        q, cand, hits = q[start][fits], cand[start][fits], hits[fits]
        best = np.lexsort((-hits, q))
        done = -1
        for x, y in zip(q[best].tolist(), cand[best].tolist()):
            if x == done:
                continue
            o = len(members(x) & members(y))
            if 100 * o >= percent * (int(sizes[x]) + int(sizes[y]) - o):
                gone.append(x)
                done = x
    return gone


class Union:
    """Disjoint sets over 0..n-1; ``root`` of an array is vectorised."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                return r
            r = nxt

    def join(self, a: int, b: int) -> None:
        ra, rb = (int(self.root(np.array([x]))[0]) for x in (a, b))
        self.up[max(ra, rb)] = min(ra, rb)
        self.up[[a, b]] = min(ra, rb)
