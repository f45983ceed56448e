"""A Bloom filter of bounded size, so that rows needn't be shuffled to learn that they aren't wanted.

The table has 16 bits a key, but 16 MB at most. With more keys it lets more
unwanted rows through; an exact join follows, so results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import shuffle_width, tidy
from lodestone.llm.setjoin import K1, U64, mix

MOST_LOG_BITS = 27
HASHES = 3
SLICE_BYTES = 1 << 16


def line_keys(doc_id: np.ndarray, text_hash: np.ndarray, line: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit key for each line (or, with 0, each text) of documents."""
    with np.errstate(over="ignore"):
        text = mix(mix(doc_id.astype(np.int64).view(U64) ^ K1) + text_hash.astype(np.int64).view(U64))
        return mix(text + (np.asarray(line, np.int64) + 1).astype(U64) * K1)


def _places(keys: np.ndarray, log_bits: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            yield (mix(keys + U64(k) * K1) >> U64(64 - log_bits)).astype(np.int64)


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the table; never False for one that is."""
    out = np.ones(len(keys), bool)
    for p in _places(keys, (8 * len(table)).bit_length() - 1):
        out &= (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def bit_table(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of ``keys(doc_id long, text_hash long, line int)``, ``n`` rows.

    Tasks set bits in tables of their own, slices are united on the executors,
    and the driver gets the table, 16 MB at most.
    """
    log_bits = min(MOST_LOG_BITS, max(16, (16 * max(n, 1) - 1).bit_length()))
    size = 1 << (log_bits - 3)
    step = min(size, SLICE_BYTES)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint8)
        for b in batches:
            for p in _places(line_keys(*(c.to_numpy(zero_copy_only=False) for c in b.columns)), log_bits):
                np.bitwise_or.at(table, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        some = [k for k in range(0, size, step) if table[k : k + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // step for k in some], pa.int32()), pa.array([table[k : k + step].tobytes() for k in some], pa.binary())], ["slice", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(bits, np.uint8)
                whole[k] = whole[k] | got if k in whole else got
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], ["slice", "bits"])

    kind = "slice int, bits binary"
    parts = keys.select("doc_id", "text_hash", "line").mapInArrow(tidy(fill), kind).repartition(min(size // step, shuffle_width(keys.sparkSession)), "slice")
    table = np.zeros(size, np.uint8)
    for r in parts.mapInArrow(unite, kind).collect():  # 16 MB at most
        table[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return table
