"""Packing: concatenate all documents, cut the stream into fixed windows.

Pass 1 tokenizes each document once and writes its ids, its input partition
and the tokens before it in that partition to the shared folder. The totals
of the partitions (one row each) give every partition's global offset by a
prefix sum; pass 2 adds the two offsets and cuts each document where the
global stream crosses a multiple of the window. No document moves to another
task, no sort is needed, and only partition totals reach the driver.

Defined results: null or empty text is the end id alone; a document of any
length is cut as often as needed; repeated rows are packed each; a null
doc_id is kept; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, small_batches, tidy

CACHE_BYTES = 16 << 20
SLICE_BYTES = 8 << 20
SPACE = re.compile("[ \t\n\r]")
_LOADED: dict[str, "WordTokenizer"] = {}


def _classes() -> tuple[str, str]:
    """Letters and numbers below U+0180, as character-class text."""
    of = lambda kind: "".join(chr(i) for i in range(0x180) if unicodedata.category(chr(i))[0] == kind)
    return of("L"), of("N")


def _byte_names() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others count up from
    U+0100 in byte order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def regrouped(items: pa.BinaryArray, offsets: pa.Array) -> pa.BinaryArray:
    """Neighbouring byte strings joined, as ``offsets`` of a list array say.

    The bytes stay where they are; only the offsets get fewer.
    """
    _, at, data = items.buffers()
    at = np.frombuffer(at, "<i4", len(items) + 1) if at is not None and at.size else np.zeros(1, "<i4")
    new = np.ascontiguousarray(at[np.asarray(offsets)], "<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(new) - 1, [None, pa.py_buffer(new), data if data is not None else pa.py_buffer(b"")])


class Recent:
    """Word ids as Arrow columns in two generations, bounded in bytes.

    When the young generation is full it becomes the old one and the old one
    goes; a word that is met again moves to the young one, so frequent words
    stay. Sizes are looked at between slices, so the young generation may
    exceed its half by the words of one slice.
    """

    def __init__(self, most_bytes: int):
        self.most = most_bytes // 2
        self.empty = (pa.array([], pa.string()), pa.array([], pa.binary()))
        self.young = self.old = self.empty

    def ids(self, words: pa.StringArray, compute: Callable[[str], bytes]) -> pa.BinaryArray:
        """Ids of distinct words; ``compute`` is asked for those not met lately."""
        if sum(x.nbytes for x in self.young) > self.most:
            self.old, self.young = self.young, self.empty
        known, known_ids = (pa.concat_arrays([x, y]) for x, y in zip(self.young, self.old))
        at = pc.index_in(words, value_set=known)
        missing = words.filter(pc.is_null(at))
        fresh = pa.array([compute(w) for w in missing.to_pylist()], pa.binary())
        again = pc.fill_null(pc.greater_equal(at, len(self.young[0])), False)
        self.young = (
            pa.concat_arrays([self.young[0], words.filter(again), missing]),
            pa.concat_arrays([self.young[1], known_ids.take(at.filter(again)), fresh]),
        )
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).copy()
        place[place < 0] = len(known) + np.arange(len(missing))
        return pa.concat_arrays([known_ids, fresh]).take(pa.array(place))


class WordTokenizer:
    """Ids of whole texts, equal to the tokenizer's own, by distinct words.

    Its normaliser lower-cases and its splitter never joins across white
    space, so below U+0180 a text's ids are those of its space-separated
    chunks. The chunks of a slice of texts are dictionary-encoded, the
    distinct ones split into words, and each distinct word that was not met
    lately goes through the model; the rest is done by Arrow on columns. Texts with other
    characters (and those few below on which Python's notion of space or case
    differs), or with the content of an added token, go through the tokenizer
    whole; if an added token is matched after normalising, all texts do.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE_BYTES):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        letters, numbers = _classes()
        space = "\t-\r \x85\xa0"
        self.split = f"([{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{space}{letters}{numbers}]+)"
        added = self.full.get_added_tokens_decoder().values()
        self.added = ["" if t.normalized else t.content for t in added]  # "" is in every text
        self.odd = re.compile("[^\x00-\x1b\x20-\u017f]|\u0130")
        self.names = _byte_names()
        self.pairs = [k.to_bytes(2, "little") for k in range(1 << 16)]
        self.words = Recent(cache_bytes)
        self.slice_bytes = slice_bytes

    def word(self, w: str) -> bytes:
        if not w:
            return b""
        mapped = w if w.isascii() and w.isprintable() else "".join([self.names[b] for b in w.encode()])
        return b"".join([self.pairs[t.id] for t in self.model.tokenize(mapped)])

    def _whole(self, text: str) -> bool:
        """Whether a text must go through the tokenizer itself."""
        if any([a in text for a in self.added]):
            return True
        if text.isascii():
            return any([c in text for c in "\x1c\x1d\x1e\x1f"])
        return self.odd.search(text) is not None

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that ``_whole`` lets pass."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        chunks = lists.flatten().dictionary_encode()
        # the blank after each word leaves an empty one at the end, which has no ids
        pieces = pc.split_pattern(pc.replace_substring_regex(chunks.dictionary, self.split, "\\1 "), " ")
        words = pieces.flatten().dictionary_encode()
        ids = self.words.ids(words.dictionary, self.word)
        distinct = regrouped(ids.take(words.indices), pieces.offsets)
        return regrouped(distinct.take(chunks.indices), lists.offsets).to_pylist()

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers.

        The work goes by slices of bounded size; a text beyond the bound is
        cut at white space, which no word crosses.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for r, ids in zip(rows, self._by_chunks(held)):
                out[r].append(ids)
            rows.clear()
            held.clear()
            size = 0

        for r, text in enumerate(texts):
            if self._whole(text):
                out[r].append(np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2").tobytes())
                continue
            for piece in cut_at_spaces(text, self.slice_bytes):
                if held and size + len(piece) > self.slice_bytes:
                    flush()
                rows.append(r)
                held.append(piece)
                size += len(piece)
        if held:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


def cut_at_spaces(text: str, most: int) -> Iterator[str]:
    """Pieces of about ``most`` characters, cut only before white space."""
    at = 0
    while len(text) - at > most:
        found = SPACE.search(text, at + most)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of all documents in the packed stream.

    Columns: doc_id, start (the document's ids before the piece), length, ids
    (binary, little-endian 16-bit), doc_tokens, sequence_id, offset. Sequence
    ``s`` holds the stream from ``s * window``; only the last one is short
    (padded to the window unless its length is a power of two, see
    ``padded_length``). Vocabularies up to 65,536 ids are supported.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "pack")
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        part, before = TaskContext.get().partitionId(), 0
        for b in small_batches(batches, 2000):
            ids = [x + end for x in tok.batch([x or "" for x in b.column(1).to_pylist()])]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(np.full(len(ids), part, np.int64)), pa.array(at), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "n", "ids"],
            )

    coded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(encode), "doc_id long, part long, before long, n long, ids binary")
    coded = scratch.save(coded, "ids")
    totals = coded.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).orderBy("part").collect()  # a row for each input partition
    starts = accumulate((r["total"] for r in totals), initial=0)
    base = spark.sparkContext.broadcast({r["part"]: s for r, s in zip(totals, starts)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = base.value
        for b in batches:
            rows: list[tuple] = []
            for doc, part, before, n, ids in zip(*(b.column(i).to_pylist() for i in range(5))):
                at, start = offsets[part] + before, 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    length = min(window - off, n - start)
                    rows.append((doc, start, length, ids[2 * start : 2 * (start + length)], n, seq, off))
                    start += length
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return coded.select("doc_id", "part", "before", "n", "ids").mapInArrow(
        tidy(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def padded_length(length: int, window: int = 2048) -> int:
    """Stored length of a sequence: a power of two stays, others get the window."""
    return length if length and length & (length - 1) == 0 else window


def ids_crc32(ids: bytes) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array([ids_crc32(x) for x in b.column(3).to_pylist()], pa.int64())
            keep = [b.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*keep, crc, *(b.column(i) for i in range(4, 7))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return pieces.mapInArrow(tidy(digest), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
