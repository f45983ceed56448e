"""Seekable Zstandard WARC bundles.

Records are gathered into frames that decompress on their own; a bundle is
frames, then an index frame (a skippable frame that maps a record id to its
frame, offset and length), then the seek table of the seekable format (a
skippable frame with the sizes of all frames before it). A reader finds the
footer from the end, looks a record up and decompresses one frame.

Bundles are rows ``(bundle, content)`` that Spark writes to the shared folder,
so any file system that Spark knows will do and a lost task leaves nothing
half-written; ``content`` is a complete ``.warc.zst`` file.

Defined results: null html is an empty payload; equal payloads below
``least_bytes`` are written each; rows with the least page_id of a payload are
its responses (repeated rows too); a row with a null page_id is a response;
rows of one page_id have a record each under the same record id;
an empty table makes no bundle; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, byte_texts, even_join, maybe_broadcast, ship, tidy

# Magic numbers of the Zstandard skippable and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head but no payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class BundleWriter:
    """Collects records; ``close`` gives the bundle's bytes."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[str] = []
        self.open = bytearray()
        self.raw = 0

    def add(self, key: str, data: bytes) -> None:
        self.index.append(f"{key}\t{len(self.frames)}\t{len(self.open)}\t{len(data)}")
        self.open += data
        self.raw += len(data)
        if len(self.open) >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        self._end_frame()
        index = skippable(SKIPPABLE_INDEX, "\n".join(self.index).encode())
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
        return b"".join(self.frames) + index + skippable(SKIPPABLE_SEEK, table)


class BundleReader:
    """Reads one bundle by its footer."""

    def __init__(self, content: bytes):
        import zstandard

        self.content, self.zstd = content, zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        start = len(content) - 9 - 8 * n
        sizes = [struct.unpack_from("<II", content, start + 8 * i) for i in range(n)]
        self.at, self.sizes, self.places = [], sizes, None
        pos = 0
        for packed, _ in sizes:
            self.at.append(pos)
            pos += packed

    def frame(self, k: int) -> bytes:
        packed, raw = self.sizes[k]
        return self.zstd.decompress(self.content[self.at[k] : self.at[k] + packed], max_output_size=raw)

    def index(self) -> list[tuple[str, int, int, int]]:
        """``(record id, frame, offset, length)`` of every record, in order."""
        body = self.content[self.at[-1] + 8 : self.at[-1] + self.sizes[-1][0]].decode()
        out = []
        for line in filter(None, body.split("\n")):
            key, frame, offset, length = line.rsplit("\t", 3)
            out.append((key, int(frame), int(offset), int(length)))
        return out

    def get(self, key: str) -> list[bytes]:
        """The records with an id; only their frames are decompressed.

        The index is read once for a reader. An id has several records where
        rows of one page_id were written.
        """
        if self.places is None:
            self.places = {}
            for k, *place in self.index():
                self.places.setdefault(k, []).append(place)
        return [self.frame(f)[at : at + n] for f, at, n in self.places.get(key, [])]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record, cut out of its frame by the index."""
        now, data = -1, b""
        for _, frame, offset, length in self.index():
            if frame != now:
                now, data = frame, self.frame(frame)
            yield parse(data[offset : offset + length])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """``(headers, block)`` of a record."""
    end = data.index(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    start = end + 4
    return headers, data[start : start + int(headers["Content-Length"])]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """Length and digest of the full payload, and the bytes that are here.

    A response's digest is computed again and must be the header's.
    """
    head, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length")))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return length, digest, body


def page_number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(tail) if tail else None


def revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 100) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the payloads that repeat an earlier page's."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    seen = scratch.save(seen.where(F.col("page_id").isNotNull() & (F.col("n") >= least_bytes)).select("page_id", "digest"), "seen")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("pages")).where("last > refers_to")
    first = scratch.save(first.select("digest", "refers_to", "pages"), "first")
    again = even_join(seen, first, "digest", "pages", seen.count())  # one payload may be a third of all pages
    return again.where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, scratch: Scratch, least_bytes: int = 100, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Archives of all pages: ``(bundle string, content binary)``, on disk."""
    ship(pages.sparkSession)
    repeats = maybe_broadcast(scratch.save(revisits(pages, scratch, least_bytes), "revisits"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    rows = rows.join(repeats, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, w = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes=frame_bytes)

        def out(w: BundleWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{k:06d}.warc.zst"]), pa.array([w.close()], pa.binary())], ["bundle", "content"])

        for b in batches:
            # payloads stay bytes: text that isn't valid UTF-8 is kept as it is
            for page_id, url, payload, refers_to in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), byte_texts(b.column(2)), b.column(3).to_pylist()):
                url = url.decode(errors="replace")
                w.add(f"urn:page:{'' if page_id is None else page_id}", record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to))
                if w.raw >= bundle_bytes:
                    yield out(w)
                    k, w = k + 1, BundleWriter(frame_bytes=frame_bytes)
        if w.raw:
            yield out(w)

    return scratch.save(rows.mapInArrow(tidy(bundle), "bundle string, content binary"), "bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """``(record_id, bundle, frame, offset, length)``: where every record lies."""
    ship(bundles.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = BundleReader(content).index()
                keys, frames, offsets, lengths = zip(*found) if found else ([],) * 4
                cols = [pa.array(keys, pa.string()), pa.array([name] * len(found), pa.string()), *(pa.array(x, pa.int64()) for x in (frames, offsets, lengths))]
                yield pa.RecordBatch.from_arrays(cols, ["record_id", "bundle", "frame", "offset", "length"])

    return bundles.select("bundle", "content").mapInArrow(tidy(read), "record_id string, bundle string, frame long, offset long, length long")


def fetch(bundles: DataFrame, index: DataFrame, record_ids: list[str]) -> DataFrame:
    """``(record_id, record binary)`` of some records.

    ``index``: ``record_index``. Only their bundles are read, and of these
    only their frames are decompressed.
    """
    ship(bundles.sparkSession)
    places = index.where(F.col("record_id").isin(record_ids)).groupBy("bundle").agg(F.collect_set("record_id").alias("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = BundleReader(content)
                found = [(i, data) for i in ids for data in reader.get(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), pa.array([d for _, d in found], pa.binary())], ["record_id", "record"])

    return bundles.join(F.broadcast(places), "bundle").select("content", "ids").mapInArrow(tidy(read), "record_id string, record binary")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, with its payload (null in a revisit)."""
    ship(bundles.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for h, block in BundleReader(content).records():
                    n, digest, body = payload_of(h, block)
                    kind = h["WARC-Type"]
                    rows.append((page_number(h["WARC-Record-ID"]), h["WARC-Target-URI"], n, digest, kind, page_number(h.get("WARC-Refers-To")), body if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return bundles.select("content").mapInArrow(
        tidy(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
