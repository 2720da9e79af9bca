"""Held-out accuracy, the effect of swapped identity terms, and edge rows."""

import binascii
import random

import numpy as np
import pandas as pd

from movecheck.llm import toxicity
from movecheck.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    # The smaller tables hold a few dozen toxic labels, too few to learn every hostile word from.
    sf_dir = "/root/testdata/sf0.1"
    found = QUERIES["op6_toxicity"](spark, sf_dir).toPandas()
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    both = found.merge(labels, on="doc_id")
    remainder = both.doc_id.map(lambda i: binascii.crc32(str(i).encode()) % 4 == 2)
    assert (both.held_out == remainder).all()
    held = both[both.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() >= 0.97
    assert held[held.toxic == 1].predicted.mean() >= 0.8
    assert held[held.toxic == 0].predicted.mean() <= 0.02
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()


def _biased(n=400):
    """Hostile texts name one group, neutral texts seldom do; hostility is in other words."""
    draw = random.Random(4)
    filler = [f"word{chr(97 + i)}" for i in range(26)]
    docs, labels = [], []
    for i in range(n):
        words = draw.choices(filler, k=12)
        toxic = i % 2
        if toxic and draw.random() < 0.7:
            words.append(draw.choice(["vile", "filthy"]))
        if draw.random() < (0.6 if toxic else 0.05):
            words.append("muslims")
        draw.shuffle(words)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return docs, labels


def test_swaps_reduce_scores_of_neutral_mentions(spark):
    docs, labels = _biased()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    y = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    plain, fair = (toxicity.fit(d, y, swap_penalty=p) for p in (0.0, 1.0))
    neutral, swapped = "worda wordb muslims wordc", "worda wordb christians wordc"
    gap = lambda m: abs(m.score(neutral) - m.score(swapped))
    assert gap(plain) > 0.2 and gap(fair) < 0.05
    assert fair.score(neutral) < plain.score(neutral)
    assert fair.score("worda vile wordb") > 0.8


def test_swaps_stay_in_their_group():
    pairs = toxicity.swapped_sentences("Many muslims came. Others left. Two men sat.")
    assert {frozenset(a ^ b) for a, b in pairs if "muslims" in a} >= {frozenset({"muslims", "jews"})}
    assert all("left" not in a for a, _ in pairs)
    assert toxicity.swapped_sentences(None) == []


def test_solver_finds_the_minimum():
    draw = np.random.default_rng(0)
    docs = [sorted(set(draw.integers(0, 6, 3).tolist())) for _ in range(60)]
    labels = (draw.random(60) < 0.4).astype(float)
    swaps = [([0, 2], [1, 2]), ([3], [4])]
    bias, w = toxicity.solve(docs, labels, swaps, 6, steps=4000)

    def loss(b, w):
        z = np.array([b + w[d].sum() for d in docs])
        prior = np.log((labels.sum() + 0.5) / (60 - labels.sum() + 0.5))
        change = sum((w[b_].sum() - w[a].sum()) ** 2 for a, b_ in swaps)
        return np.logaddexp(0, z).sum() - labels @ z + 0.025 * (w @ w + (b - prior) ** 2) + 0.5 * change

    best = loss(bias, w)
    for _ in range(200):
        assert loss(bias + draw.normal(0, 0.01), w + draw.normal(0, 0.01, 6)) >= best - 1e-9


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "vile", "c"), (3, "word " * 50_000 + "vile", "d"), (3, "vile", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")
    model = toxicity.Classifier(-3.0, {"vile": 6.0})
    scores = [(r.doc_id, round(r["__score"], 4)) for r in toxicity.scored(docs, model).collect()]
    low, high = round(1 / (1 + np.exp(3)), 4), round(1 / (1 + np.exp(-3)), 4)
    assert scores == [(1, low), (2, low), (None, high), (3, high), (3, high)]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 2]
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0)):
        assert 0 < toxicity.fit(docs, some).score("anything") < 1
    assert toxicity.scored(docs.limit(0), model).count() == 0
