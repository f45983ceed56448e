"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and over word stems: the first
``STEM`` letters of its longer words, told apart by how many of the text's
distinct words share them (one, two, three or more), which covers inflected
and compound words that the sample shows rarely. Every labelled text is also
seen with the identity terms of each of its sentences swapped for others, or
with one added to a sentence where it has none ("counterfactual"), and the
squared change of the score is penalised, so a mention of a group by itself
doesn't move the score.

Fitting uses a bounded sample: at most ``max_each`` labelled doc_ids of either
class, those with the least hash, and one row of each. A feature enters the
model if ``least_texts`` sample texts hold it and its share differs between the
classes by ``least_z`` standard errors; this is a test of significance, not a
number of features. Identity terms are always in. Scoring has no limits: all
rows are scored, whole.

Defined results: a null or empty text is scored as a text without words;
several labels of one doc_id count as their largest; rows with a null doc_id
are scored and never used to fit; with one class only, or no labels, every
score is the (smoothed) share of label 1; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, ship, tidy
from lodestone.llm.quality import least_ids, may_learn, one_text

MAX_EACH = 6000
LEAST_TEXTS = 3
LEAST_Z = 2.5
STEM = 5
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?]\s|\n")

# Identity terms, interchangeable within a group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "hispanic", "african", "arab", "indian", "chinese", "mexican"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)


TERMS = frozenset(t for group in IDENTITY_TERMS for t in group)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def stems_of(words: Iterable[str]) -> set[str]:
    """``stem*`` of each stem, ``stem**`` and ``stem***`` if more words share it."""
    out: set[str] = set()
    for stem, n in Counter([w[:STEM] for w in words if len(w) > STEM]).items():
        out.update([stem + "*" * k for k in range(1, min(n, 3) + 1)])
    return out


def features(words: set[str]) -> set[str]:
    """Words and stems; identity terms only as the words they are."""
    return words | stems_of(words - TERMS)


def terms_of(text: str) -> list[list[str]]:
    """The identity terms of each sentence that has some."""
    return [sorted(found) for s in SENTENCE.split(text) if (found := words_of(s) & TERMS)]


def swapped(terms: Iterable[str], turn: int) -> set[str]:
    """Every term of a sentence replaced by another of its group, all at once.

    ``turn`` picks by how far a group is rotated, so the same sentence gets
    different counterfactuals and no two terms become one.
    """
    out: set[str] = set()
    for group in IDENTITY_TERMS:
        step = 1 + turn % (len(group) - 1)
        out.update(group[(i + step) % len(group)] for i, t in enumerate(group) if t in terms)
    return out


def counterfactual(sentences: list[list[str]], turn: int) -> set[str]:
    """Identity terms of a text after the swap, sentence by sentence."""
    if not sentences:
        group = IDENTITY_TERMS[turn % len(IDENTITY_TERMS)]
        return {group[turn // len(IDENTITY_TERMS) % len(group)]}
    return set().union(*(swapped(s, turn + k) for k, s in enumerate(sentences)))


@dataclass(frozen=True)
class Model:
    """Feature weights; a text's score needs the set of its words only."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        g = self.bias + sum(map(self.weights.get, self.weights.keys() & features(words_of(text))))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


Row = tuple[bytes, tuple[tuple[str, ...], ...], int]  # places in the vocabulary (32-bit, ascending), identity terms by sentence, label


def fit_counterfactual(sample: list[Row], vocabulary: list[str], penalty: float = 1.0, decay: float = 2e-4, steps: int = 300, rate: float = 0.1, turns: int = 4) -> Model:
    """Class-balanced logistic loss, L2, and the counterfactual penalty.

    ``vocabulary``: words, then all identity terms, sorted. Texts with the same
    words and label are one row with a weight. Words are places of a sparse
    matrix; identity terms, in which a twin differs from its text, are dense
    columns of their own.
    """
    same = Counter(sample)
    rows = sorted(same)
    count = np.array([same[k] for k in rows], np.float64)
    labels = np.array([k[2] for k in rows])
    total = count.sum()
    terms, d = sorted(TERMS), len(vocabulary) - len(TERMS)
    term_place = {t: k for k, t in enumerate(terms)}
    held = [np.frombuffer(k[0], np.int32) for k in rows]
    every = np.concatenate([*held, np.zeros(0, np.int32)])
    of = np.repeat(np.arange(len(rows)), [len(h) for h in held])
    at, of = every[every < d], of[every < d]

    def columns(sets: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(sets), len(terms)))
        for r, s in enumerate(sets):
            x[r, [term_place[t] for t in s]] = 1
        return x

    x = columns([{vocabulary[j] for j in h[h >= d].tolist()} for h in held])
    twins = [columns([counterfactual(list(k[1]), 7 * r + t) for r, k in enumerate(rows)]) for t in range(turns)]
    weight = count * np.where(labels == 1, 0.5 / max(1.0, count[labels == 1].sum()), 0.5 / max(1.0, count[labels == 0].sum()))
    n = len(rows)
    w, b = np.zeros(d + len(terms)), 0.0  # words, then terms
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for step in range(1, steps + 1):
        plain = np.bincount(of, w[at], n) + b
        s = sig(plain + x @ w[d:])
        both = weight * (s - labels)
        gw = decay * w
        gw[d:] += x.T @ both
        for xt in twins:
            st = sig(plain + xt @ w[d:])
            change = 2 * penalty * count * (s - st) / (total * turns)
            up, down = change * s * (1 - s), change * st * (1 - st)
            gw[d:] += x.T @ up - xt.T @ down
            both = both + up - down
        gw[:d] += np.bincount(at, both[of], d)
        gb = both.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model({v: float(x) for v, x in zip(vocabulary, w)}, float(b))


def fit(
    docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1,
    max_each: int = MAX_EACH, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z,
) -> Model:
    """Fit on at most ``max_each`` labelled doc_ids of each class, a row of each."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(may_learn(mod, held) & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = lambda k: least_ids(lambda near: known.where(near & (F.col("label") == k)), sizes.get(k, 0), max_each).withColumn("label", F.lit(k))
    texts = one_text(docs, picked(1).unionByName(picked(0)))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = [t or "" for t in b.column(1).to_pylist()]
            found = pa.array([sorted(features(words_of(t))) for t in all_texts], pa.list_(pa.string()))
            terms = pa.array([terms_of(t) for t in all_texts], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0), found, terms], ["label", "found", "terms"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(texts.select("label", "text").mapInArrow(bags, "label int, found array<string>, terms array<array<string>>"), "sample")
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0
    if not ones or ones == n:  # one class only
        p = (ones + 1) / (n + 2)
        return Model({}, float(np.log(p / (1 - p))))
    counts = sample.select("label", F.explode("found").alias("w")).groupBy("w").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    zeros = n - ones
    share = (F.col("p") + F.col("q")) / F.lit(n)
    strength = F.abs(F.col("p") / ones - F.col("q") / zeros) / F.sqrt(share * (1 - share) * F.lit(1 / ones + 1 / zeros) + 1e-12)
    admitted = counts.where(F.col("p") + F.col("q") >= least_texts).where(strength >= least_z)
    words = {r["w"] for r in admitted.select("w").collect()}  # of the bounded sample
    vocabulary = sorted(words - TERMS) + sorted(TERMS)
    place = {w: k for k, w in enumerate(vocabulary)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(sorted(place[w] for w in x if w in place), np.int32).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["label", "found", "terms"])

    rows = sample.mapInArrow(narrow, "label int, found binary, terms array<array<string>>").collect()  # the bounded sample, vocabulary only
    scratch.drop("sample")
    return fit_counterfactual([(bytes(r["found"]), tuple(map(tuple, r["terms"])), r["label"]) for r in rows], vocabulary)


def scorer(model: Model):
    """A column function: text to score."""

    def work(batches: Iterator) -> Iterator:
        for text in batches:
            yield pd.Series([model.score(t or "") for t in text], dtype="float64")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(work)(batches)

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row."""
    score = scorer(fit(docs, labels, mod, held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", F.coalesce(~may_learn(mod, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
