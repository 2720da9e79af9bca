"""Toxicity: a word and word-beginning classifier, regularised by swapped identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movecheck.llm.common import fresh, released, staged, vacate

#: Labelled documents the classifier is fitted on at most (those of the smallest hash).
MAX_LABELLED = 20_000
#: Features the classifier has at most (the most significant ones).
MAX_FEATURES = 20_000
THRESHOLD = 0.3
#: Lengths of word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_WORDS = pa.list_(pa.string())
_SWAPS = pa.list_(pa.struct([("a", _WORDS), ("b", _WORDS)]))
_NUMBERS = pa.list_(pa.list_(pa.list_(pa.int32())))
_SENTENCE = re.compile(r"[^.!?\n]+")

#: Identity terms by group; the first of each list is its neutral mention.
IDENTITY_TERMS = {
    "religion": "believer christian muslim jew buddhist hindu atheist catholic protestant sikh",
    "religions": "believers christians muslims jews buddhists hindus atheists catholics protestants sikhs",
    "origin": "person african american arab asian european latino immigrant refugee black white",
    "origins": "people africans americans arabs asians europeans latinos immigrants refugees blacks whites",
    "gender": "person woman man girl boy transgender",
    "genders": "people women men girls boys",
    "orientation": "partner gay lesbian bisexual straight heterosexual homosexual queer",
    "ability": "member disabled blind deaf autistic paralyzed",
    "de": "menschen frauen männer juden muslime christen ausländer flüchtlinge schwule lesben",
    "fr": "gens femmes hommes juifs musulmans chrétiens étrangers réfugiés gays lesbiennes",
    "es": "personas mujeres hombres judíos musulmanes cristianos extranjeros refugiados gais lesbianas",
}


def _partners() -> dict[str, list[str]]:
    found: dict[str, set[str]] = {}
    for terms in IDENTITY_TERMS.values():
        for term in terms.split():
            found.setdefault(term, set()).update(set(terms.split()) - {term})
    return {term: sorted(others) for term, others in found.items()}


PARTNERS = _partners()


def features(words: set[str]) -> set[str]:
    """The words and their beginnings (marked by a caret)."""
    return words | {"^" + w[:n] for w in words for n in BEGINNINGS if len(w) >= n}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped_sentences(text: str | None) -> list[tuple[set[str], set[str]]]:
    """Words of each sentence that names an identity, before and after each term is swapped."""
    pairs = []
    for sentence in _SENTENCE.findall((text or "").lower()):
        words = set(_WORD.findall(sentence))
        for term in sorted(words & PARTNERS.keys()):
            pairs += [(words, words - {term} | {other}) for other in PARTNERS[term]]
    return pairs


@dataclass
class Classifier:
    """Logistic regression on the presence of features."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]] | None = None) -> float:
        found: set[str] = set()
        memo = {} if memo is None else memo
        for word in words_of(text):
            known = memo.get(word)
            if known is None:
                known = tuple(f for f in features({word}) if f in self.weights)
                memo[word] = known
            found.update(known)
        logit = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))))


#: Words whose features a task remembers; they take about 20 MB.
MEMO_WORDS = 100_000


def held_out(id: str) -> F.Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2


def labelled_sample(labels: DataFrame, id: str, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids (``__id``, ``__y``), those of the smallest hash, without held-out ones."""
    rows = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id))
    rows = rows.groupBy(F.col(id).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("__y"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(limit)


class _Rows:
    """Sparse 0/1 rows as (row, column) pairs."""

    def __init__(self, rows: list[list[int]], n: int) -> None:
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.at = np.repeat(np.arange(len(rows)), self.lengths)
        self.columns = np.array([c for r in rows for c in r], dtype=np.int64)
        self.rows, self.n = len(rows), n

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.columns], minlength=self.rows)

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=v[self.at], minlength=self.n)


def solve(
    docs: list[list[int]],
    labels: np.ndarray,
    swaps: list[tuple[list[int], list[int]]],
    n_features: int,
    ridge: float = 0.05,
    swap_penalty: float = 1.0,
    steps: int = 500,
) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise

    log loss + ridge / 2 |w|² + swap_penalty / 2 * sum over swaps of (change of the logit)²

    by accelerated gradient steps from zero, each coordinate with its own bound of the
    curvature, so that the same inputs always give the same weights.
    """
    n = n_features + 1  # the last is the bias
    x = _Rows([[*d, n_features] for d in docs], n)
    before, after = (_Rows([s[k] for s in swaps], n) for k in (0, 1))
    prior = np.zeros(n)
    prior[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    bound = 0.25 * x.sums(x.lengths.astype(float)) + ridge
    if swaps:
        touched = (before.lengths + after.lengths).astype(float)
        bound += swap_penalty * (before.sums(touched) + after.sums(touched))
    w = ahead = prior.copy()
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead), -40, 40)))
        gradient = x.sums(p - labels) + ridge * (ahead - prior)
        if swaps:
            change = swap_penalty * (after.times(ahead) - before.times(ahead))
            gradient += after.sums(change) - before.sums(change)
        moved = ahead - gradient / bound
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = moved + (momentum - 1) / faster * (moved - w), moved, faster
    return float(w[-1]), w[:-1]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    label: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    max_features: int = MAX_FEATURES,
    swap_penalty: float = 1.0,
) -> Classifier:
    """Fit on labelled documents whose crc32(id) mod 4 isn't 2 (an action).

    At most ``max_labelled`` of them are used: their ids and labels are broadcast, so no text
    is shuffled. Spark counts the features; kept are those whose odds ratio is above three
    by two standard errors, or below one by five, and identity terms, ``max_features`` in all.
    Only the sample's kept features, which these two numbers bound, come to the driver.
    Without labels of both kinds the classifier is the prior alone.
    """
    sample = F.broadcast(labelled_sample(labels, id, label, max_labelled))
    texts = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(sample, "__id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pydict()
            found = [sorted(features(words_of(t))) for t in data["__text"]]
            swaps = [
                [{"a": sorted(features(a)), "b": sorted(features(b))} for a, b in swapped_sentences(t)]
                for t in data["__text"]
            ]
            columns = [pa.array(data["__y"], pa.int32()), pa.array(found, _WORDS), pa.array(swaps, _SWAPS)]
            yield pa.RecordBatch.from_arrays(columns, ["y", "found", "swaps"])

    swap_type = "array<struct<a:array<string>,b:array<string>>>"
    rows = staged(texts.mapInArrow(extract, f"y int, found array<string>, swaps {swap_type}"))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not positive or positive == n:
        return Classifier(float(np.log((positive + 0.5) / (n - positive + 0.5))))
    counted = (
        rows.select("y", F.explode("found").alias("f"))
        .groupBy("f")
        .agg(F.sum("y").cast("double").alias("k1"), F.sum(1 - F.col("y")).cast("double").alias("k0"))
    )
    a, b = F.col("k1") + 0.5, positive - F.col("k1") + 0.5
    c, d = F.col("k0") + 0.5, n - positive - F.col("k0") + 0.5
    odds = F.log(a * d / (b * c))
    error = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    # Surely thrice as likely in toxic texts, or far less likely there than by chance.
    sure = F.when(odds > 0, odds - 2 * error - log(3.0)).otherwise(-odds - 5 * error)
    identity = F.col("f").isin(sorted(PARTNERS))
    chosen = counted.withColumn("sure", sure).filter(identity | (F.col("sure") > 0))
    best = chosen.orderBy(F.desc(identity), F.desc("sure"), "f").limit(max_features)
    names = sorted(r.f for r in best.select("f").collect())
    index = {f: i for i, f in enumerate(names)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(found: list[str]) -> list[int]:
            return [index[f] for f in found if f in index]

        for batch in batches:
            data = batch.to_pydict()
            found = [numbers(f) for f in data["found"]]
            swaps = [[[numbers(s["a"]), numbers(s["b"])] for s in row] for row in data["swaps"]]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(swaps, _NUMBERS)]
            yield pa.RecordBatch.from_arrays(columns, ["y", "found", "swaps"])

    data = rows.mapInArrow(number, "y int, found array<int>, swaps array<array<array<int>>>").toArrow().to_pydict()
    swaps = [(a, b) for row in data["swaps"] for a, b in row]
    bias, weights = solve(data["found"], np.array(data["y"], dtype=float), swaps, len(names), swap_penalty=swap_penalty)
    return Classifier(bias, {f: float(w) for f, w in zip(names, weights)})


def scored(docs: DataFrame, model: Classifier, text: str = "text", score_column: str = "__score") -> DataFrame:
    """``docs`` with ``score_column``, the probability of label 1, from the whole text.

    A column of that name is replaced. Null and empty texts get the bias alone; an empty table
    stays empty. The model is at most ``MAX_FEATURES`` weights.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vacate()
        memo: dict[str, tuple[str, ...]] = {}
        for batch in texts:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            yield pd.Series([share.value.score(t, memo) for t in batch], dtype="float64")
        memo.clear()
        released()

    return docs.withColumn(score_column, score(F.col(text)))


def without_toxic(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; columns unchanged, whatever their names."""
    score = fresh(docs, "__score")
    return scored(docs, model, text, score).filter(F.col(score) < threshold).drop(score)
