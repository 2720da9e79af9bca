"""Phrase mining: brute force over random texts, block and shard borders, edge rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from movecheck.llm import phrase_mining

KINDS = "doc_id bigint, text string, lang string"


def _brute(rows, top, min_count, max_words, contained):
    f, size = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            size[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in often.items():
            inner = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= contained * a for b in inner):
                continue
            score, _, left, right = min(
                (1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def _mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    return sorted(tuple(r) for r in phrase_mining.collocations(docs, **options).collect())


def _random_rows(seed, n):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "the", "né", "Of", "x1", "日本", "end", "q", "z"]
    rows = []
    for i in range(n):
        words = draw.choices(vocabulary, weights=range(1, 11), k=draw.randint(0, 40))
        said = "".join(w + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in words)
        rows.append((i, said, draw.choice(["en", "de", None, ""])))
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"min_count": 3, "block_words": 50},
        {"min_count": 2, "block_words": 200, "max_words": 4, "shards": 2, "contained": 70},
        {"min_count": 4, "shards": 5, "top": 7, "block_words": 30},
    ],
)
def test_brute_force(spark, options):
    rows = _random_rows(7, 90)
    wanted = _brute(rows, options.get("top", 2000), options["min_count"], options.get("max_words", 3), options.get("contained", 50))
    assert wanted and _mined(spark, rows, **options) == wanted


def test_phrases_of_late_shards_are_counted_from_the_start(spark):
    # The words reach the threshold in the last block only; most of the phrase stands before.
    rows = [(i, "alpha beta gamma", "en") for i in range(12)] + [(50 + i, f"other{i} words{i}", "en") for i in range(30)]
    found = _mined(spark, rows, min_count=12, block_words=4)
    assert [r[2:4] for r in found] == [("alpha beta gamma", 12)]


def test_edge_rows(spark):
    long = "so on " * 120_000
    rows = [(1, None, "en"), (2, "", "en"), (None, "a b! a b", None), (None, "a b! a b", None), (3, long, "fr"), (4, " \t.;", "en")]
    found = _mined(spark, rows, min_count=4, block_words=1000)
    assert found == _brute(rows, 2000, 4, 3, 50)
    assert ("und", 1, "a b", 4, 4, 4, 8, 1000000) in found
    clashing = spark.createDataFrame([(1, "p q", "en", 5, "w")] * 3, KINDS + ", n int, h0 string")
    assert [tuple(r) for r in phrase_mining.collocations(clashing, min_count=3).collect()] == [("en", 1, "p q", 3, 3, 3, 6, 1000000)]
    empty = spark.createDataFrame([], KINDS)
    assert phrase_mining.collocations(empty).collect() == []


def test_exact_beyond_64_bits(spark):
    # 1000000 * a * a passes 64 bits from a = 3,037,000 on.
    docs = spark.createDataFrame([(1, "x y x y " * 800_000, "en")], KINDS)
    found = {r.phrase: r for r in phrase_mining.collocations(docs).collect()}
    a = {"x y x": 1_599_999, "y x y": 1_599_999}
    assert {p: r.a for p, r in found.items()} == a
    for p, r in found.items():
        assert r.score == 1000000 * r.a * r.a // (r.l * r.r)


def test_wide_blocks_use_the_long_form():
    codes = np.array([0, 1, 2, 0, 1, 2, -1, 0, 1], dtype=np.int32)
    at = np.array([0, 1, 3])
    for distinct in (3, 1 << 30):
        words, n = phrase_mining.counted(codes, at, 3, distinct)
        assert sorted(zip(*[w.tolist() for w in words], n.tolist())) == [(0, 1, 2, 2), (1, 2, 0, 1)]


def test_a_phrase_that_is_counted_moves_no_more(spark, monkeypatch):
    stage, plans, moved = phrase_mining.staged, [], []

    def watched(df):
        out = stage(df)
        if "start" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            moved.extend(out.select("k", "start", "h0", "h1", "h2").collect())
        return out

    monkeypatch.setattr(phrase_mining, "staged", watched)
    docs = spark.createDataFrame(_random_rows(5, 90), KINDS).repartition(3)
    rows = phrase_mining.collocations(docs, min_count=3, block_words=50).collect()
    assert rows and moved
    # Once for each step of its cycle of three shards.
    assert max(moved.count(row) for row in set(moved)) <= 3
    # Blocks are summed already: rows are grouped after they have moved, not before as well.
    assert all(plan.rindex("HashAggregate") < plan.index("Exchange") for plan in plans)


def test_blocks_spell_every_text(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("a b. A", "en"), ("a c", None), ("", "en"), ("!", "de"), ("b\ta ", "en")])]
    docs = spark.createDataFrame(rows, KINDS).coalesce(1)
    (block,) = phrase_mining.coded(docs, "text", "lang", 3, 42, 1000).collect()
    codes = np.frombuffer(block.codes, dtype="<i4").tolist()
    said = [None if c < 0 else (block.langs[c], block.words[c]) for c in codes]
    pieces = [[]]
    for word in said:
        pieces[-1].append(word) if word else pieces.append([])
    wanted = [[("en", "a"), ("en", "b")], [("en", "a")], [("en", "b"), ("en", "a")], [("und", "a"), ("und", "c")]]
    assert sorted(p for p in pieces if p) == sorted(wanted)
    assert dict(zip(zip(block.langs, block.words), block.counts)) == Counter(w for w in said if w)
