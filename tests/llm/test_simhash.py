"""Fingerprints and components against plain Python."""

import random
import re

import pandas as pd
import xxhash

from movecheck.llm import simhash
from movecheck.llm.queries import QUERIES


def plain_fingerprint(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id reachable for each (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(fps)}


def test_fingerprint_matches_definition():
    texts = [None, "", "  \n", "One", "One two", "ONE two Three", "a b c a b c a b c", "É é\x85x y\x1cz w", "x " * 500]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    draw = random.Random(3)
    text = " ".join(draw.choice("abcdefg") * draw.randint(1, 3) for _ in range(1000))
    whole = simhash.fingerprint(text)
    for size in (2, 3, 7, 100):
        monkeypatch.setattr(simhash, "CHUNK_WORDS", size)
        assert simhash.fingerprint(text) == whole


def test_query_matches_brute_force(spark, sf_dir):
    found = QUERIES["op2_simhash_near_dedup"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    fps = [(int(i), plain_fingerprint(t)) for i, t in zip(docs.doc_id, docs.text)]
    assert dict(zip(found.doc_id, found.fingerprint)) == {i: f"{f:016x}" for i, f in fps}
    assert dict(zip(found.doc_id, found.component_id)) == plain_components(fps)


def test_dense_groups_in_blocks(spark):
    """Chains of near fingerprints, split over many blocks, keep their components."""
    draw = random.Random(5)
    fps = set()
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(60):
            base ^= 1 << draw.randrange(64)
            fps.add(base)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    for block in (5, 1000):
        edges = simhash.fingerprint_links(df, simhash.PivotTable(), block=block)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        mine = {}
        for (s,) in signed:
            mine.setdefault(roots.get(s, s), set()).add(s)
        theirs = {}
        for f, c in plain_components(list(enumerate(fps))).items():
            theirs.setdefault(c, set()).add(signed[f][0])
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_pivot_coordinates_never_discard_a_link():
    import numpy as np

    draw = random.Random(7)
    table = simhash.PivotTable()
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, 5)):
            b ^= 1 << bit
        left, right = (np.array([x], dtype=np.uint64).view(np.int64) for x in (a, b))
        near = (a ^ b).bit_count() <= 3
        assert table.links(left, right)[0, 0] == near
        if near:
            assert any((x == y).all() for x, y in zip(table.keys(left), table.keys(right)))


def test_no_text_goes_with_a_repeated_id(spark):
    rows = [(5, "alpha beta gamma delta"), (5, "one two three four five six"), (9, "one two three four five six"), (5, "alpha beta gamma delta"), (6, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id, r.text or "") for r in simhash.deduplicated(df).collect())
    assert kept == [(5, "alpha beta gamma delta"), (5, "one two three four five six"), (6, "")]
    plan = simhash.deduplicated(df.limit(3))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan or "left_anti" in plan.lower()


def test_edge_rows(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3), (7, None, 4), (6, "", 5), (9, "q r s t u v", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(None, 5), (5, 5), (7, 6), (6, 6), (9, 9), (None, 6)}
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [5, 6, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
