"""Periodic runs: brute force over words with few letters, stacked periods and Fibonacci words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from movecheck.llm import periodic_runs, queries


def _brute(words, min_length=6, min_times=4):
    """(start, period, length) of all runs, every period tried at every word."""
    n, found = len(words), {}
    for q in range(1, n // min_times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def _collapsed(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _words(draw):
    kind = draw.randrange(5)
    if kind == 0:
        return [draw.choice("ab") for _ in range(draw.randint(0, 70))]
    if kind == 1:
        out = []
        for _ in range(draw.randint(1, 5)):
            unit = [draw.choice("abcd") for _ in range(draw.randint(1, 12))]
            out += (unit * draw.randint(1, 9))[: draw.randint(1, 90)]
        return out
    if kind == 2:
        unit = ["a"] * draw.randint(1, 12) + ["b"]
        return ((unit * draw.randint(2, 6) + [draw.choice("abc")]) * draw.randint(1, 6))[draw.randint(0, 3) :]
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        for _ in range(draw.randint(1, 7)):
            a, b = b, b + a
        return b * draw.randint(1, 5)
    return [f"w{draw.randrange(400)}" for _ in range(draw.randint(0, 200))]


def test_brute_force_on_numbers():
    draw = random.Random(3)
    for _ in range(600):
        texts, whole, wanted = [_words(draw) for _ in range(draw.randint(1, 4))], [], []
        for i, words in enumerate(texts):
            wanted += [(s + len(whole), q, length) for s, q, length in _brute(words)]
            whole += [*words, f"end {i}"]
        numbers = np.unique(whole, return_inverse=True)[1]
        assert [(s, q, length) for s, length, q in periodic_runs.runs_of(numbers).tolist()] == sorted(wanted)


def test_wavelet_tree_counts_and_selects():
    draw = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 700):
        values = draw.permutation(n)
        tree = periodic_runs.WaveletTree(values)
        low = draw.integers(0, n, 50)
        high = np.minimum(n, low + draw.integers(1, n + 1, 50))
        than = draw.integers(0, 2 * n + 2, 50)
        assert tree.smaller(low, high, than).tolist() == [int((values[a:b] < t).sum()) for a, b, t in zip(low, high, than)]
        nth = (draw.random(50) * (high - low)).astype(np.int64)
        assert tree.smallest(low, high, nth).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, nth)]


@pytest.mark.parametrize("chunk", [10, 60_000])
def test_rows_against_brute_force(spark, chunk):
    draw = random.Random(9)
    rows = [(i, draw.choice([" ", "\n", " \t "]).join(_words(draw))) for i in range(60)]
    rows += [(0, rows[0][1]), (None, "x y " * 5), (None, "x y " * 5), (70, None), (71, ""), (72, " \n\x0b ")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, runs int, id string")
    out = periodic_runs.periodic_runs(df, chunk_words=chunk).collect()
    found = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out)
    wanted = []
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = _brute(words)
        wanted.append((str(doc_id), len(words), [(s, length, q) for s, q, length in runs], _collapsed(words, runs)))
    assert found == sorted(wanted)


def test_very_long_text_and_empty_table(spark):
    unit = " ".join(f"w{i}" for i in range(5_000))
    text = "start " + " ".join([unit] * 20) + " end no break"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = periodic_runs.periodic_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(1, 100_000, 5_000)]
    assert row.collapsed == "start " + unit + " end no break"
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.array([0]), min_times=3)


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    out = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert out.keys() == docs.keys()
    planted = 0
    for doc_id, text in docs.items():
        words = re.findall("[^\x20\x09-\x0d]+", text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = _brute(words) if len(words) < 1500 else [(s, q, x) for s, x, q in _own(words)]
        row = out[doc_id]
        best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=(None, None, None))
        assert (row.n_runs, row.start, row.period, row.length) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[2] // best[1] if runs else None)
        listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()
    assert planted and any(r.n_runs for r in out.values())


def _own(words):
    numbers = np.unique([*words, "end of text"], return_inverse=True)[1]
    return periodic_runs.runs_of(numbers).tolist()
