"""Benchmark decontamination by an Aho-Corasick automaton.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
after lower-casing A-Z. A window is ``window`` consecutive words of a
benchmark item (the whole item if it is shorter). The automaton holds the
anchors of the items: of every item, blocks of ``window // 2 + 1`` words at a
fixed stride, such that each window has a whole block inside; a shorter item
is one block. Each text is normalised and scanned once; where an anchor
occurs, text and item are compared word by word to both sides, and a common
run of a window's length or more is a hit. That is the same as looking for
every window, with a fifth of the patterns at half their length. Hits are
mapped back to word numbers and to character offsets of the original text.

The benchmark is dealt into shards of at most ``max_nodes`` characters of
anchors (a node of the automaton takes about 64 bytes). The driver holds one
shard's items at a time; a task passes over its texts, ``CHUNK_BYTES`` at a
time, once for each shard, and keeps one automaton. A usual benchmark is one
shard, by the same code.

Defined results: a null or empty text has no words and is clean; an item
without words has no window; the windows of an item with a null item_id hit
words but add no id; equal items all count; repeated rows come back
each; an empty benchmark leaves every text clean; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_texts, ship, slices, tidy

MAX_NODES = 2_000_000
CHUNK_BYTES = 32 << 20
_BUILT: dict[str, "Anchors"] = {}

#: every ASCII byte that is no letter or digit becomes a space, A-Z become a-z
FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
Item = tuple[str | None, str]


def folded(text: bytes) -> bytes:
    """Words joined by single spaces."""
    return b" ".join(text.translate(FOLD).split())


def anchors(words: list[str], window: int) -> Iterator[tuple[int, str]]:
    """``(first word, block)`` of an item, with a space on both sides."""
    if len(words) < window:
        yield 0, f" {' '.join(words)} "
        return
    size = window // 2 + 1
    for k in range(0, len(words) - size + 1, window - size + 1):
        yield k, f" {' '.join(words[k : k + size])} "


class Anchors:
    """The automaton of a shard, and the items' words to compare with."""

    def __init__(self, items: list[Item], window: int):
        import ahocorasick

        self.window, self.ids = window, [i for i, _ in items]
        self.words = [t.split(" ") for _, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for at, block in anchors(w, window):
                places.setdefault(block, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for block, found in places.items():
            self.automaton.add_word(block, (block.count(" ") - 1, found))
        if places:
            self.automaton.make_automaton()

    def scan(self, norm: bytes) -> tuple[list[list[int]], set[str]]:
        """Hit runs ``[first word, end word)`` of a folded text, and item ids."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if not norm or not len(self.automaton):
            return spans, items
        text = f" {norm.decode()} "
        words: list[str] = []
        seen: dict[tuple[int, int], int] = {}  # how far an alignment of item and text is known
        done_chars = done_words = 0
        for end, (n, places) in self.automaton.iter(text):
            done_words += text.count(" ", done_chars, end)
            done_chars = end
            first = done_words - n  # words before the closing space, less the block's
            words = words or text[1:-1].split(" ")
            for k, at in places:
                item = self.words[k]
                a, b = first, first + n
                if len(item) >= self.window:
                    if seen.get((k, first - at), 0) >= b:
                        continue
                    i, j = at, at + n
                    while a and i and words[a - 1] == item[i - 1]:
                        a, i = a - 1, i - 1
                    while b < len(words) and j < len(item) and words[b] == item[j]:
                        b, j = b + 1, j + 1
                    seen[k, first - at] = b
                    if b - a < self.window:
                        continue
                spans.append([a, b])
                if self.ids[k] is not None:
                    items.add(self.ids[k])
        return united(spans), items


def shards(benchmark: DataFrame, window: int, max_nodes: int) -> Iterator[list[Item]]:
    """Items as ``(id, folded text)`` in lists of bounded size, one at a time.

    An item larger than the bound is cut, with an overlap of ``window - 1``
    words, so that every window lies in a piece.
    """
    held: list[Item] = []
    nodes = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").toLocalIterator():
        words = [w.decode() for w in folded(r["t"].encode()).split()]
        piece = max(window, max_nodes // 16)
        for k in range(0, max(len(words) - window + 1, 1) if words else 0, piece):
            part = words[k : k + piece + window - 1]
            cost = sum(len(b) for _, b in anchors(part, window))
            if held and nodes + cost > max_nodes:
                yield held
                held, nodes = [], 0
            held.append((r["i"], " ".join(part)))
            nodes += cost
    if held:
        yield held


class Detector:
    """A benchmark, sent to the workers shard by shard."""

    def __init__(self, benchmark: DataFrame, window: int, max_nodes: int):
        ship(benchmark.sparkSession)
        context = benchmark.sparkSession.sparkContext
        self.window, self.parts = window, []
        for items in shards(benchmark, window, max_nodes):
            key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
            self.parts.append((key, context.broadcast(items)))

    def built(self, k: int) -> Anchors:
        """Of a worker process's shards, the one in use."""
        key, items = self.parts[k]
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Anchors(items.value, self.window)
        return _BUILT[key]

    def scans(self, norms: list[bytes]) -> tuple[list[list[list[int]]], list[set[str]]]:
        """Hit runs and item ids of each text; shards outside, texts inside."""
        runs: list[list[list[int]]] = [[] for _ in norms]
        items: list[set[str]] = [set() for _ in norms]
        order = list(range(len(self.parts)))
        if order and self.parts[-1][0] in _BUILT:
            order.reverse()  # begin with the automaton that is there
        for k in order:
            shard = self.built(k)
            for x, norm in enumerate(norms):
                s, i = shard.scan(norm)
                if s:
                    runs[x] = united(runs[x] + s)
                    items[x] |= i
        return runs, items


def char_spans(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Word runs as ``[start, end)`` code points of the original text."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [[at[a][0], at[b - 1][1]] for a, b in spans]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``most`` bytes, so that few passes cover a task."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_nodes: int = MAX_NODES) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` for each row.

    ``items``: sorted item ids with an occurring window; ``spans``: the hit
    runs as code-point offsets of the original text.
    """
    detect = Detector(benchmark, window, max_nodes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = byte_texts(b.column(1))
            norms = [folded(t) for t in texts]
            runs, items = detect.scans(norms)
            n_words = [n.count(b" ") + 1 if n else 0 for n in norms]
            n_hit = [sum(e - s for s, e in r) for r in runs]
            spans = [char_spans(t.decode(), r) if r else [] for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(scan), "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>")


def detector(benchmark: DataFrame, window: int = 10, max_nodes: int = MAX_NODES):
    """A column function: text to whether ``contamination`` finds a hit."""
    detect = Detector(benchmark, window, max_nodes)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            # one shard keeps its automaton from slice to slice; several take a batch at once
            found = [detect.scans([folded(t) for t in byte_texts(part)])[0] for part in slices(column, 1000 if len(detect.parts) == 1 else 10_000)]
            yield pa.array([bool(r) for runs in found for r in runs], pa.bool_())

    @F.arrow_udf("boolean")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(work)(batches)

    return hit


def united(spans: list[list[int]]) -> list[list[int]]:
    """Runs sorted, touching and overlapping ones joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
