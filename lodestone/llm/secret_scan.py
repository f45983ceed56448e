"""Secret scan with a trigram inverted index.

Each rule's regex is parsed, and a Boolean query over trigrams that any match
must contain is derived from it. A block of texts is indexed (trigram to the
texts that hold it, for the trigrams that the rules ask for); postings are
united and intersected, and only the candidates are searched with the regex.
A rule without a mandatory trigram searches every text.

Trigrams are of the text's UTF-8 bytes with A-Z lower-cased, so a query
never misses a match, whatever a rule's case.

Defined results: a null or empty text has no span; spans are code points of
the original text, end exclusive; repeated rows come back each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, tidy

MOST_STRINGS = 64
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The kinds of the base rules, then the added ones, in order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

# A query: None (no condition), an int (a trigram), ("and" | "or", parts).
Query = None | int | tuple


def _strings(node) -> set[str] | None:
    """All strings that a parsed item can match, if they are few; else None."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if kind is op.IN:
        out: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                out.add(chr(a).lower() if a < 128 else chr(a))
            elif k is op.RANGE and a[1] - a[0] < 8:
                out |= {chr(x).lower() if x < 128 else chr(x) for x in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is op.SUBPATTERN:
        return _product(arg[3])
    if kind is op.BRANCH:
        parts = [_product(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 2:
        one = _product(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= now
            now = {a + b for a in now for b in one}
        return out if len(out) <= MOST_STRINGS else None
    return None


def _product(items) -> set[str] | None:
    out = {""}
    for node in items:
        got = _strings(node)
        if got is None or len(out) * len(got) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in got}
    return out


def _both(word: str, parts: list[Query]) -> Query:
    """And / or of queries, with the trivial ones folded."""
    if word == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (word, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    def one(s: str) -> Query:
        b = s.encode()
        return _both("and", [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)])

    return _both("or", [one(s) for s in sorted(strings)])


def _of_items(items) -> Query:
    parts: list[Query] = []
    run = {""}
    for node in items:
        got = _strings(node)
        if got is not None and len(run) * len(got) <= MOST_STRINGS:
            run = {a + b for a in run for b in got}
            continue
        parts.append(_of_strings(run))
        run = {""} if got is None else got
        if got is None:
            parts.append(_of_node(node))
    return _both("and", [*parts, _of_strings(run)])


def _of_node(node) -> Query:
    kind, arg = node
    if kind is op.SUBPATTERN:
        return _of_items(arg[3])
    if kind is op.BRANCH:
        return _both("or", [_of_items(p) for p in arg[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
        return _of_items(arg[2])
    return None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regex; None if it has no condition."""
    return _of_items(parser.parse(pattern, re.ASCII))


def trigrams_in(query: Query) -> set[int]:
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*(trigrams_in(p) for p in query[1]))


class BlockIndex:
    """Postings of a block of texts, for the wanted trigrams."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        joined = np.frombuffer(b"\x00".join(texts).lower() + b"\x00\x00", np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
        self.n = len(texts)
        pairs = np.zeros(0, np.int64)
        for k in range(0, len(joined) - 2, BLOCK_BYTES):  # a slice's codes at a time, whatever a text's size
            part = joined[k : k + BLOCK_BYTES + 2]
            code = part[:-2].astype(np.int32)
            code <<= 8
            code |= part[1:-1]
            code <<= 8
            code |= part[2:]
            at = np.flatnonzero(wanted[code])
            found, doc = code[at], np.searchsorted(starts, at + k, side="right") - 1
            pairs = np.union1d(pairs, found.astype(np.int64) * max(1, self.n) + doc)
        tri, doc = pairs // max(1, self.n), pairs % max(1, self.n)
        cuts = np.flatnonzero(np.diff(tri)) + 1
        self.lists = {int(t[0]): d for t, d in zip(np.split(tri, cuts), np.split(doc, cuts)) if len(t)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.lists.get(query, np.zeros(0, np.int64))
        word, parts = query
        found = sorted((self.candidates(p) for p in parts), key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if word == "and" else np.union1d(out, f)
        return out


def scan_block(texts: list[str], rules: tuple[Rule, ...], queries: list[Query], compiled: list[re.Pattern], wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """``(start, kind number, end)`` of all secrets, sorted, for each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    index = BlockIndex([t.encode() for t in texts], wanted)
    for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
        for d in index.candidates(query):
            out[d] += [(s, k, e) for s, e in rule.spans(pattern, texts[d])]
    for x in out:
        x.sort()
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, secret>>)`` for each row."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [r.compiled() for r in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[sorted(set().union(*(trigrams_in(q) for q in queries)))] = True
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows, block, size = [], [], 0
            for t in [*texts, None]:
                if t is None or size > BLOCK_BYTES:
                    if block:
                        for text, found in zip(block, scan_block(block, rules, queries, compiled, wanted)):
                            rows.append([{"kind": rules[k].kind, "start": s, "end": e, "secret": text[s:e]} for s, k, e in found])
                    block, size = [], 0
                if t is not None:
                    block.append(t)
                    size += len(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(scan), "doc_id long, spans array<struct<kind: string, start: long, end: long, secret: string>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_secrets``."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
