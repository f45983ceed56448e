"""Vector code compression: product codes whose codebooks are trained by Yinyang Lloyd.

Vectors become integers and are cut into equal parts, each with a codebook of
its own. Codebook entries are clustered into groups of about ten. A vector
keeps, for each part, an upper bound of the distance to its entry and one
lower bound for each group on the distances to the group's other entries.
When entries move, bounds shift by the entry's and the group's largest drift;
only groups whose shifted lower bound does not exceed the upper bound are
scanned. Bounds are rounded outwards and compared with slack, and every
distance that decides is an exact integer, so ties go to the lower index and
the result is that of plain Lloyd.

Vectors, codes and bounds are rows of a table that is written once a round
(the table before goes), so a lost executor costs the tasks that run. The
sums of an entry are made within tasks, then added up by Spark; the driver
gets the codebooks alone, of a size that parameters fix.

Defined results: rows with a null vector, or one with null or non-finite
components, are dropped; an empty table gives an empty result. Of equal
vec_ids, and null ones (which come last), the first entries are taken in the
order of the vectors. The length is that of the first vector in this order;
vectors of another length keep a row with null code and error, which adds
nothing to ``label_error``. Where the length isn't a multiple of the parts,
the first parts are one longer. Integers are held within the range in which
squared distances fit 64 bits (for 64 components: |x| up to 185,000), larger
ones saturate. Repeated rows come back each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, small_batches, tidy, unique_join

GROUP_SIZE = 10
ROWS = 2048
#: Bounds are widened by this share at each step, far above the rounding of doubles.
SLACK = 1e-9


def span(length: int) -> int:
    """Largest integer component: the squared distance of two vectors stays below 2^63."""
    return min(2**31 - 1, isqrt((2**63 - 1) // max(length, 1)) // 2)


def usable(vector: Column) -> Column:
    """No component is null, NaN or infinite (and the vector isn't null)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def quantised(vector: Column, scale: int, bound: int) -> Column:
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(bound))), F.lit(float(-bound)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def edges(length: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part."""
    small, more = divmod(length, parts)
    at = [k * small + min(k, more) for k in range(parts + 1)]
    return list(zip(at, at[1:]))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries, 64-bit."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 2**53:  # every number of the sum is an exact double
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None].astype(np.int64) - book[:, j]
        out += d * d
    return out


def own_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    d = x.astype(np.int64) - entries
    return np.einsum("ij,ij->i", d, d)


def above(d2: np.ndarray) -> np.ndarray:
    """Distances, rounded up."""
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def below(d2: np.ndarray) -> np.ndarray:
    """Distances, rounded down."""
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


def packed_up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not smaller."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def packed_down(x: np.ndarray) -> np.ndarray:
    """As 16-bit floats that are not larger (bounds below 0 say no more than 0)."""
    y = np.clip(x, 0, 65000).astype(np.float16)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(-np.inf)), y)


def groups_of(book: np.ndarray, rounds: int = 5) -> list[np.ndarray]:
    """Entries in groups of about ten near ones, each ascending; clustered from evenly taken entries."""
    n = -(-len(book) // GROUP_SIZE)
    if n <= 1:
        return [np.arange(len(book))]
    centres = book[np.linspace(0, len(book) - 1, n).astype(int)]
    for _ in range(rounds):
        mine = squares(book, centres).argmin(1)
        centres = np.array([book[mine == g].mean(0).round().astype(np.int64) if (mine == g).any() else centres[g] for g in range(n)])
    mine = squares(book, centres).argmin(1)
    return [g for g in (np.flatnonzero(mine == k) for k in range(n)) if len(g)]


class Part:
    """One part's codebook, groups, and the drifts since the last assignment."""

    def __init__(self, book: np.ndarray, groups: list[np.ndarray], before: np.ndarray | None = None):
        self.book, self.groups = book, groups
        self.group_of = np.empty(len(book), np.int64)
        for g, members in enumerate(groups):
            self.group_of[members] = g
        self.drift = above(own_squares(book, before)) if before is not None else np.zeros(len(book))
        self.group_drift = np.array([self.drift[m].max() for m in groups])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entries with bounds, from all distances."""
        d2 = squares(x, self.book)
        mine = d2.argmin(1)  # the first of equal ones
        rows = np.arange(len(x))
        upper = above(d2[rows, mine])
        others = below(d2)
        others[rows, mine] = np.inf
        return mine, upper, np.stack([others[:, m].min(1) for m in self.groups], 1)

    def again(self, x: np.ndarray, mine: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entries after the drift; the last number counts the distances taken."""
        upper = upper + self.drift[mine]
        lower = lower - self.group_drift
        rest = np.flatnonzero(lower.min(1) <= upper)
        own = own_squares(x[rest], self.book[mine[rest]])
        upper[rest] = above(own)
        scan = lower[rest] <= upper[rest, None]
        best, at = own.copy(), mine[rest].copy()
        old, found, work = at.copy(), [], len(rest)
        for g, members in enumerate(self.groups):
            here = np.flatnonzero(scan[:, g])
            if not len(here):
                continue
            d2 = squares(x[rest[here]], self.book[members])
            work += d2.size
            k = d2.argmin(1)
            least = d2[np.arange(len(here)), k]
            better = (least < best[here]) | ((least == best[here]) & (members[k] < at[here]))
            best[here] = np.where(better, least, best[here])
            at[here] = np.where(better, members[k], at[here])
            found.append((g, here, d2))
        # an entry that was left counts among its group's others
        moved = np.flatnonzero(at != old)
        g_old = self.group_of[old[moved]]
        lower[rest[moved], g_old] = np.minimum(lower[rest[moved], g_old], below(own[moved]))
        for g, here, d2 in found:
            others = below(d2)
            others[self.groups[g][None, :] == at[here, None]] = np.inf
            lower[rest[here], g] = others.min(1)
        mine = mine.copy()
        mine[rest], upper[rest] = at, above(best)
        return mine, upper, lower, work


@dataclass
class Compressed:
    """Codes of vectors, and the codebooks: for each part, integers by entry and position."""

    codes: DataFrame
    codebooks: list[np.ndarray]

    def fingerprint(self) -> str:
        numbers = (str(x) for book in self.codebooks for x in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def matrix(column, length: int) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def floats(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def assigned(state: DataFrame, parts: list[Part], cuts: list[tuple[int, int]], first: bool) -> DataFrame:
    """State of the vectors after an assignment: ints, code, upper and lower bounds."""
    length, widths = cuts[-1][1], [len(p.groups) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            if not b.num_rows:
                continue
            x = matrix(b.column(2), length)
            if not first:
                codes, uppers, lowers = (floats(b.column(3), np.uint8, len(parts)), floats(b.column(4), np.float32, len(parts)), floats(b.column(5), np.float16, sum(widths)))
            made, at = [], 0
            for k, (part, (i, j)) in enumerate(zip(parts, cuts)):
                if first:
                    made.append(part.first(x[:, i:j]))
                else:
                    made.append(part.again(x[:, i:j], codes[:, k].astype(np.int64), uppers[:, k].astype(np.float64), lowers[:, at : at + widths[k]].astype(np.float64)))
                at += widths[k]
            code = np.stack([m[0] for m in made], 1).astype(np.uint8)
            upper, lower = packed_up(np.stack([m[1] for m in made], 1)), packed_down(np.concatenate([m[2] for m in made], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), blobs(code), blobs(upper), blobs(lower)], ["vec_id", "label", "v", "code", "upper", "lower"])

    label = state.schema["label"].dataType.simpleString()
    return state.mapInArrow(tidy(run), f"vec_id long, label {label}, v array<int>, code binary, upper binary, lower binary")


def entry_sums(state: DataFrame, parts: int, cuts: list[tuple[int, int]], entries: int) -> DataFrame:
    """Rows (part, entry, n, s0, s1, ...): one for each entry that is used, added up in the tasks first."""
    length, width = cuts[-1][1], max(j - i for i, j in cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in small_batches(batches, ROWS):
            if not b.num_rows:
                continue
            x, code = matrix(b.column(0), length), floats(b.column(1), np.uint8, parts)
            for k, (i, j) in enumerate(cuts):
                order = np.argsort(code[:, k], kind="stable")
                used, at = np.unique(code[order, k], return_index=True)
                n[k, used] += np.diff(np.append(at, len(order)))
                total[k, used, : j - i] += np.add.reduceat(x[order, i:j].astype(np.int64), at, axis=0)
        part, entry = np.nonzero(n)
        cols = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["part", "entry", "n", *(f"s{d}" for d in range(width))])

    schema = ", ".join(["part int", "entry int", "n long", *(f"s{d} long" for d in range(width))])
    made = state.select("v", "code").mapInArrow(tidy(run), schema)
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return made.groupBy("part", "entry").agg(*(big(c) for c in ["n", *(f"s{d}" for d in range(width))]))


def moved(books: list[np.ndarray], cuts: list[tuple[int, int]], sums: DataFrame) -> list[np.ndarray]:
    """Codebooks whose used entries are the floor of their parts' mean. At most a row for each entry is collected."""
    out = [b.copy() for b in books]
    for part, entry, n, *total in (tuple(r) for r in sums.collect()):
        i, j = cuts[part]
        out[part][entry] = [int(s) // int(n) for s in total[: j - i]]
    return out


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, scratch: Scratch | None = None) -> Compressed:
    """Product codes of all vectors and the codebooks they were trained to.

    Codes: vec_id, label, code (bytes, one for each part), error (squared
    distance to the entries, summed over parts). ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "codes")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("x")).where(usable(F.col("x")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    head = kept.orderBy(*order).select(F.size("x").alias("n")).first()
    kinds = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code binary, error long"
    if head is None:
        return Compressed(spark.createDataFrame([], kinds), [np.zeros((0, 0), np.int64)] * parts)
    length = head["n"]
    same = F.size("x") == length
    state = scratch.save(kept.where(same).select("vec_id", "label", quantised(F.col("x"), scale, span(length)).alias("v")), "state-0")
    # by the integers, which order equal vec_ids as well as the vectors do
    seeds = np.array([r["v"] for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()], np.int64).reshape(-1, length)
    cuts = edges(length, parts)
    books = [seeds[:, i:j] for i, j in cuts]
    groups = [groups_of(b) for b in books]
    before: list[np.ndarray | None] = [None] * parts
    for k in range(rounds + 1):
        now = [Part(*x) for x in zip(books, groups, before)]
        state = scratch.save(assigned(state, now, cuts, k == 0), f"state-{k + 1}")
        scratch.drop(f"state-{k}")
        if k < rounds:
            before, books = books, moved(books, cuts, entry_sums(state, parts, cuts, len(seeds)))
    codes = state.select("vec_id", "label", "v", "code").mapInArrow(tidy(errors(books, cuts)), kinds)
    others = kept.where(~same).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return Compressed(codes.unionByName(others), books)


def errors(books: list[np.ndarray], cuts: list[tuple[int, int]]):
    """Batch function: codes with their squared distance instead of the vector."""
    length = cuts[-1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            if not b.num_rows:
                continue
            x, code = matrix(b.column(2), length), floats(b.column(3), np.uint8, len(cuts))
            error = sum(own_squares(x[:, i:j], book[code[:, k]]) for k, ((i, j), book) in enumerate(zip(cuts, books)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def decoded(codes: DataFrame, codebooks: list[np.ndarray], scale: int = 1024) -> DataFrame:
    """Codes with the vector that they stand for (``approx``, doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            rows = [None if c is None else np.concatenate([book[k] for book, k in zip(codebooks, c)]) / scale for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "approx"])

    ship(codes.sparkSession)
    return codes.select("vec_id", "code").mapInArrow(tidy(run), "vec_id long, approx array<double>")


def digest(found: Compressed, scratch: Scratch) -> DataFrame:
    """Codes as hex with each label's error and the codebooks' fingerprint."""
    key = [F.col("label").isNull().alias("no_label"), F.col("label")]
    codes = scratch.save(found.codes, "codes")
    of = codes.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error"))
    of = scratch.save(of, "labels")
    total, n_labels = codes.count(), of.count()
    some = unique_join(codes.where(~key[0]), of.where(~key[0]), "label", "n", total, n_labels)
    none = of.where(key[0]).first()
    blank = codes.where(key[0]).select("*", F.lit(none["n"] if none else 0).alias("n"), F.lit(none["label_error"] if none else None).cast("long").alias("label_error"))
    return some.unionByName(blank).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.fingerprint()).alias("codebooks_sha256"))
