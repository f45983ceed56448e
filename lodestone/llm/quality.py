"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network; the risk is
the non-negative unbiased one, with a class prior estimated from the labels
(the share of label 1 among all labelled rows that may be used). Features are
statistics of the whole text; they don't depend on language, source or id.

The model is fitted on a bounded sample: at most ``max_positive`` trusted and
``max_unlabelled`` unlabelled rows, those with the least hash of their
doc_id. All rows are scored, by a function that is sent to the executors.

Defined results: a null or empty text is scored as a text without words; rows
with a null doc_id are scored and never used to fit; several labels of one
doc_id count as their largest; without any trusted positive or unlabelled row
every score is the prior (0.5 without labels); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship, slices, tidy

MAX_POSITIVE = 6000
MAX_UNLABELLED = 12000
THRESHOLD = 0.7
SYMBOLS = "#$%&*@^~=<>{}[]\\|_/+"
SLICE_BYTES = 2 << 20
SYMBOL_BYTES, MARK_BYTES, DIGIT_BYTES = SYMBOLS.encode(), b"!?", b"0123456789"


def features(texts: list[str]) -> np.ndarray:
    """Statistics of whole texts, a row each, roughly between 0 and 1 or a log."""
    parts, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > SLICE_BYTES:
            parts.append(_features(held))
            held, size = [], 0
        held.append(t)
        size += len(t)
    parts.append(_features(held))
    return np.concatenate(parts)


def _features(texts: list[str]) -> np.ndarray:
    """``features`` of a slice: words by code, their properties once for each distinct one."""
    n = len(texts)
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    flat = lists.flatten().dictionary_encode()
    kinds = flat.dictionary
    code, doc = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
    flag = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
    length = flag(pc.utf8_length(kinds))
    real = length[code] > 0 if len(code) else np.zeros(0, bool)
    code, doc = code[real], doc[real]
    of = lambda values: np.bincount(doc, weights=values[code], minlength=n)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(1, words)
    mean = of(length) / some
    std = np.sqrt(np.maximum(0, of(length * length) / some - mean * mean))
    same = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc[1:][same], minlength=n)
    # runs of a sorted (text, word) list are the counts of a text's distinct words
    width = max(1, len(kinds))
    pair = np.sort(doc * width + code)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    count, owner, word = np.diff(np.r_[first, len(pair)]), pair[first] // width, pair[first] % width
    distinct = np.bincount(owner, minlength=n)
    most = np.sort((owner << 32) | ((1 << 31) - count))  # a text's words, commonest first
    begin = np.cumsum(distinct) - distinct
    top = np.zeros((3, n))
    for k in range(3):
        has = distinct > k
        top[k, has] = (1 << 31) - (most[begin[has] + k] & 0xFFFFFFFF)
    fold = pc.utf8_lower(kinds).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    folded = np.bincount(np.unique(owner * width + fold[word]) // width, minlength=n) if len(word) else np.zeros(n)
    raw = [t.encode() for t in texts]
    bytes_in = lambda which: np.array([len(b) - len(b.translate(None, which)) for b in raw])
    chars = np.maximum(1, np.array([len(t) for t in texts]))
    lines = [t.split("\n") for t in texts]
    n_lines, own_lines = np.array([len(x) for x in lines]), np.array([len(set(x)) for x in lines])
    stops = np.array([t.count(". ") + t.count(".\n") + t.endswith(".") for t in texts])
    return np.stack(
        [
            np.log1p(words) / 10,
            np.log1p(n_lines) / 8,
            words / chars,
            mean / 10,
            std / 10,
            distinct / some,
            folded / some,
            np.sqrt(distinct) / np.sqrt(some),
            repeats / some,
            top[0] / some,
            top.sum(0) / some,
            of(flag(pc.utf8_is_alpha(kinds))) / some,
            of(flag(pc.utf8_is_upper(kinds))) / some,
            of(flag(pc.utf8_is_title(kinds))) / some,
            of(1 - flag(pc.match_substring_regex(kinds, r"[\pL\pN]"))) / some,
            bytes_in(SYMBOL_BYTES) / chars * 10,
            bytes_in(MARK_BYTES) / chars * 10,
            bytes_in(DIGIT_BYTES) / chars * 10,
            bytes_in(b"|") / some,
            stops / some,
            bytes_in(b",") / some,
            own_lines / np.maximum(1, n_lines),
            np.log1p(words / np.maximum(1, n_lines)) / 6,
            (words == 0).astype(np.float64),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        g = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def constant(prior: float, width: int) -> Model:
    p = min(max(prior, 1e-3), 1 - 1e-3)
    return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), prior)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, hidden: int = 16, steps: int = 800, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Model:
    """Minimise the non-negative PU risk with the logistic loss.

    Risk: ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``.
    While the second part is negative, the step goes up on it instead, as the
    non-negative estimator asks for.
    """
    everything = np.concatenate([xp, xu])
    mean, scale = everything.mean(0), everything.std(0) + 1e-6
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (xp, xu))
    rng = np.random.default_rng(seed)
    d = zp.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(prior / (1 - prior)))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def forward(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ params[0] + params[1])
        return h, h @ params[2] + params[3]

    def backward(z: np.ndarray, h: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dg, params[2]) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ dg, np.array(dg.sum())]

    for step in range(1, steps + 1):
        hp, gp = forward(zp)
        hu, gu = forward(zu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if negative >= 0:
            dp = (prior * (sig(gp) - 1) - prior * sig(gp)) / len(zp)
            du = sig(gu) / len(zu)
        else:
            dp = prior * sig(gp) / len(zp)
            du = -sig(gu) / len(zu)
        grads = [a + b for a, b in zip(backward(zp, hp, dp), backward(zu, hu, du))]
        for k, (p, g) in enumerate(zip(params, grads)):
            g = g + decay * p if p.ndim else g
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = p - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3]), prior)


def feature_rows(docs: DataFrame) -> DataFrame:
    """``(text, ...)`` to the features of each row, with its other columns."""
    others = [c for c in docs.columns if c != "text"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t or "" for t in b.column(len(others)).to_pylist()])
            cols = [b.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(x), pa.list_(pa.float64()))], [*others, "x"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select(*others, "text").mapInArrow(compute, f"{kinds}, x array<double>")


def hashed() -> Column:
    """The hash of doc_id by which samples are taken."""
    return F.xxhash64("doc_id", F.lit(11))


def least_ids(ids: Callable[[Column], DataFrame], among: int, most: int) -> DataFrame:
    """The ``most`` distinct doc_ids with the least hashes.

    ``ids``: the ids (repeated or not) of about ``among`` rows, under a
    condition. Only a share of them is looked at, more if repeats left too few.
    """
    share = min(1.0, 16 * most / max(among, 1))
    while True:
        found = ids((hashed() / 2.0**64 + 0.5 < share) if share < 1 else F.lit(True)).select("doc_id").distinct()
        if share >= 1 or found.count() >= most:
            return found.orderBy(hashed(), "doc_id").limit(most)
        share = min(1.0, 16 * share)


def one_text(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """``picks`` (unique by doc_id) with one text each: that of the least hash, if rows of an id differ.

    A row for each pick at most comes out, however many rows of an id there are.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(picks), "doc_id")
    return met.groupBy(*picks.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on bounded samples, one row for each doc_id. ``may_learn``: a condition on ``doc_id``."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(may_learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(may_learn & F.col("doc_id").isNotNull())
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    prior = min(max((ones or 0) / n, 0.02), 0.98) if n else 0.5
    positive = least_ids(lambda near: ids.where(near).join(known.where(near & (F.col("label") == 1)), "doc_id", "left_semi"), ones or 0, max_positive)
    unlabelled = least_ids(ids.where, docs.count(), max_unlabelled)
    chosen = positive.withColumn("p", F.lit(1)).unionByName(unlabelled.withColumn("p", F.lit(0)))
    picks = chosen.groupBy("doc_id").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    got = feature_rows(one_text(docs, picks).select("p", "u", "text")).collect()  # a row for each id picked, so bounded by the two limits
    xp = np.array([r["x"] for r in got if r["p"] == 1])
    xu = np.array([r["x"] for r in got if r["u"]])
    if not len(xp) or not len(xu):
        return constant(prior, features([""]).shape[1])
    return fit_nnpu(xp, xu, prior)


def scorer(model: Model):
    """A column function: text to score."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [model.scores(features([t or "" for t in part.to_pylist()])) for part in slices(column)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(work)(batches)

    return score


def may_learn(mod: int = 4, held: int = 2) -> Column:
    """Rows whose CRC-32 of the id as text isn't in the held-out remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % mod != held


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row."""
    score = scorer(fit(docs, labels, may_learn(mod, held)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", F.coalesce(~may_learn(mod, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
