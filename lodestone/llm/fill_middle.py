"""Fill-in-the-middle transformation by bit-parallel arithmetic on big integers.

A text's UTF-8 bytes are translated to a mask of one bit a byte (1: not white
space), read as one big integer. A unit ends where a 1 is followed by a 0, so
one shift and two boolean operations mark all ends at once, ``bit_count``
counts them, and the byte where the k-th unit ends is found by halving the
number again and again, counting the bits of its upper half. Nothing walks
the text token by token; work is linear in its bytes.

Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.
The two cuts and the form are drawn from a SHA-256 of seed and doc_id, so
they don't depend on order, partitions or other rows.

Defined results: a null text counts as empty; an empty text and one that
holds a sentinel stay plain; a null doc_id draws like an empty number;
repeated rows come back each, alike; an empty table gives an empty result;
other columns are ignored. Bytes that aren't UTF-8 are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_texts, ship, small_batches, tidy

SPACE = b" \t\n\x0b\x0c\r"
#: One digit a byte: 1 for bytes of words, and 1 for bytes that begin a code point.
IN_WORD = bytes(48 if b in SPACE else 49 for b in range(256))
BEGINS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def bits_of(data: bytes, table: bytes) -> int:
    """The bytes' class mask as a number, the first byte's bit highest."""
    return int(data.translate(table), 2) if data else 0


def unit_ends(data: bytes) -> int:
    """Bits set at the last byte of each unit."""
    words = bits_of(data, IN_WORD)
    ends = words & ~(words << 1)
    return ends | 1 if data and not words & 1 else ends  # white space at the end is a unit


def select(bits: int, width: int, rank: int) -> int:
    """Place from the left of the ``rank``-th set bit (from 1) of a number of ``width`` bits."""
    at = 0
    while width > 1:
        low = width >> 1
        high = bits >> low
        n = high.bit_count()
        if rank <= n:
            bits, width = high, width - low
        else:
            rank, at = rank - n, at + width - low
            bits, width = bits & ((1 << low) - 1), low
    return at


def end_of(ends: int, width: int, rank: int) -> int:
    """Bytes that the first ``rank`` units take."""
    return select(ends, width, rank) + 1 if rank else 0


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(key[k : k + 8], 16) for k in (0, 8, 16, 24))


def transformed(doc_id: int | None, data: bytes, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and output of one text."""
    ends, width = unit_ends(data), len(data)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or h3 % 100 >= rate or any(m in data for m in MARKS):
        return n, "plain", None, None, data
    a, b = (end_of(ends, width, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    chars = [bits_of(x, BEGINS).bit_count() for x in (prefix, middle)]
    p, s, m = MARKS
    if h4 % 100 < spm_rate:
        return n, "spm", *chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", *chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Each text cut into prefix, middle and suffix and put into its form.

    Columns: doc_id, n (units), form, prefix_chars, middle_chars, output.
    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these with
    the suffix first.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 250):
            rows = [transformed(i, t, seed, rate, spm_rate) for i, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)))]
            n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = whole.mapInArrow(tidy(cut), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone, natively."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda a, k: F.get(a, F.lit(k))
    join = lambda a: F.when(form == "psm", F.concat(part(a, 1), part(a, 3), part(a, 2))).otherwise(F.concat(part(a, 2), part(a, 3), part(a, 1)))
    return F.when(form == "plain", output).otherwise(F.get(F.transform(F.array(parts), join), F.lit(0)))


def digest(found: DataFrame) -> DataFrame:
    """The rows with hashes of output and restored text instead of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
