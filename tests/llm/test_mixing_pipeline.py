"""Rates against plain Python, the pipeline stage by stage."""

import numpy as np
import pytest

import corpus_pipeline
from movecheck.llm import common, line_dedup, mixing, queries, simhash, toxicity
from movecheck.llm.byte_bpe import encoder


def test_rates_meet_targets(spark, sf_dir):
    found = queries.QUERIES["op4_mix_to_targets"](spark, sf_dir).toPandas()
    p, tokens, rate = np.array(found.posterior.tolist()), found.n_tokens.to_numpy(), found.rate.to_numpy()
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = queries.labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = sorted(r.domain for r in labelled.select("domain").distinct().collect())
    target = np.array([queries.TARGETS.get(d, 0) for d in names])
    totals = (p * (rate * tokens)[:, None]).sum(axis=0)
    assert np.abs(totals / tokens.sum() - target / target.sum()).max() < 1e-3
    assert (found.domain == [names[i] for i in p.argmax(axis=1)]).all()
    words = {r.doc_id: len((r.text or "").split()) for r in docs.select("doc_id", "text").collect()}
    assert all(abs(words[i] - n) <= 2 for i, n in zip(found.doc_id, found.n_tokens))


def test_rates_stay_positive_and_least_squares(spark):
    """A target that asks for less than nothing of a domain stops at zero."""
    draw = np.random.default_rng(0)
    p = draw.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = draw.integers(1, 50, 200)
    soft = spark.createDataFrame([(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p))], "id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    steps, gap = mixing.fit_rates(soft, [1.0, 0.0, 0.0], 200, 1e-6)
    rate = np.array([r.r for r in soft.select("id", mixing._rate(steps, 3).alias("r")).orderBy("id").collect()])
    plain = np.ones(200)
    for step in steps:
        plain = np.maximum(0, plain + p @ np.array(step))
    assert np.allclose(rate, plain) and (rate >= 0).all() and (rate == 0).any()
    totals = (p * (rate * tokens)[:, None]).sum(axis=0) / tokens.sum()
    assert totals[0] > 0.85 and totals[1:].max() < 0.1
    assert gap == pytest.approx(np.abs(totals - [1, 0, 0]).max())


def test_posteriors_match_plain_bayes(spark):
    rows = [(1, "a a b", "x"), (2, "b c", "x"), (3, "d d e", "y"), (4, None, "y"), (5, "a", None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "d " * 50), (None, "e")], "doc_id bigint, text string")
    domains = mixing.learned(labelled)
    found = {r.id: (r.n_tokens, r.p0) for r in mixing.posteriors(docs, domains).collect()}
    n = mixing.BUCKETS
    x = {w: np.log((k + 1) / (5 + n)) for w, k in {"a": 2, "b": 2, "c": 1, "d": 0, "e": 0}.items()}
    y = {w: np.log((k + 1) / (3 + n)) for w, k in {"a": 0, "b": 0, "c": 0, "d": 2, "e": 1}.items()}
    for id, words in [(1, "ab"), (2, ""), (3, ""), (4, "d" * 50), (None, "e")]:
        soft = min(1, mixing.EVIDENCE / max(1, len(words)))
        gap = soft * sum(y[w] - x[w] for w in words)
        assert found[id][0] == len(words) and found[id][1] == pytest.approx(1 / (1 + np.exp(gap)), abs=1e-9)


def test_mixing_edge_tables(spark):
    docs = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (None, None, 7)], "doc_id bigint, text string, rate int")
    none = spark.createDataFrame([], "text string, domain string")
    rated = mixing.rates(docs, none, {"x": 1.0})
    assert sorted((r.doc_id or 0, r.domain, r.n_tokens, r.rate) for r in rated.collect()) == [(0, None, 0, 1.0), (1, None, 2, 1.0)]
    assert sorted(map(str, mixing.repeated(docs, rated).collect())) == sorted(map(str, docs.collect()))
    known = spark.createDataFrame([("a", "x"), ("b", "y")], "text string, domain string")
    assert mixing.rates(docs.limit(0), known, {"x": 1.0}).count() == 0
    twice = mixing.rates(docs, known, {"x": 1.0})
    assert mixing.repeated(docs, twice).columns == docs.columns


def test_skewed_tables_meet_targets(spark):
    """Four fifths of the tokens are to become one fifth: shares are met and no text is lost."""
    rows = [(i, "a" if i % 5 else "b", 30, 0.25 if i % 5 else 4.0) for i in range(3_000)]
    rated = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, rate double")
    mixed = mixing.repeated(rated.select("doc_id", "text"), rated).toPandas()
    assert set(mixed.doc_id) == set(range(3_000))
    assert (mixed.text == "a").mean() == pytest.approx(0.2, abs=0.01)


def test_raise_factor_is_what_the_shares_need(spark):
    def factor(rows):
        return mixing.raise_factor(spark.createDataFrame(rows, "n_tokens bigint, rate double"))

    assert factor([(10, 1.0), (10, 1.5)]) == 1.0 and factor([(10, 0.0)]) == 1.0 and factor([(0, 0.1)]) == 1.0
    draw = np.random.default_rng(5)
    for low in (0.7, 0.24, 0.03):
        tokens, rate = draw.integers(1, 100, 500), draw.uniform(low, 2, 500)
        found = factor([(int(t), float(r)) for t, r in zip(tokens, rate)])
        assert found <= 2 ** (1 / mixing.RAISE_STEPS) / rate.min()
        raised = np.maximum(1, found * rate) * tokens
        assert np.abs(raised / raised.sum() - rate * tokens / (rate @ tokens)).sum() / 2 <= mixing.TOLERANCE
    # Texts of a hundredth of the tokens at a rate of next to nothing: a hundredfold will do.
    assert 95 < factor([(99_000, 1.0), (1_000, 1e-12)]) < 106
    # A text of a millionth of the tokens does not repeat all others thousandfold.
    assert factor([(10**6, 0.5), (10**6, 1.5), (1, 0.001)]) < 2.2


def test_rates_say_how_far_they_came(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", "xy"[i % 4 == 0]) for i in range(40)], "doc_id bigint, text string, domain string")
    few = mixing.rates(docs, docs, {"x": 0.4, "y": 0.6}, max_rounds=1).first()
    assert few.gap > mixing.TOLERANCE


def test_tiny_rates_repeat_no_more_than_shares_need(spark):
    rows = [(i, "a" if i % 100 else "b", 10, 1.0 if i % 100 else 1e-12) for i in range(2_000)]
    rated = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, rate double")
    mixed = mixing.repeated(rated.select("doc_id", "text"), rated).toPandas()
    assert set(mixed.doc_id) == set(range(2_000)) and len(mixed) < 230_000
    assert (mixed.text == "b").mean() <= 1.05 * mixing.TOLERANCE


def test_clashing_columns_pass_through(spark):
    """Columns named like the helpers of every stage keep their values."""
    names = ["__id", "__gone", "__text", "__lines", "__removed", "__rate", "__times", "__copy", "__score", "id", "fp", "wanted"]
    rows = [(i, f"text {i} of some words\ncommon line", "s%d" % (i % 12), *[f"{n}{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    extra = {r.doc_id: tuple(r[n] for n in names) for r in docs.collect()}

    def unharmed(df):
        return df.columns == docs.columns and all(tuple(r[n] for n in names) == extra[r.doc_id] for r in df.collect())

    model = toxicity.Classifier(-5.0, {"text": 0.1})
    assert unharmed(toxicity.without_toxic(docs, model))
    cleaned = line_dedup.without_boilerplate(docs, lines_column="n_lines", removed_column="n_removed")
    assert unharmed(cleaned.drop("n_lines", "n_removed")) and cleaned.filter("n_removed = 1").count() == 29
    assert unharmed(simhash.deduplicated(docs))
    rated = spark.createDataFrame([(i, 5, 1.0 + i % 2) for i in range(30)], "doc_id bigint, n_tokens bigint, rate double")
    assert unharmed(mixing.repeated(docs, rated)) and mixing.repeated(docs, rated).count() == 45


def test_stages_take_odd_rows(spark, sf_dir):
    """Null and repeated ids with different texts, null and very long texts go through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, "nobody's text of a few words"), (3, None), (3, "another text under an id in use"), (3, "another text under an id in use"), (5, ""), (7, "so " * 200_000)]
    rows = [tuple(dict(zip(docs.columns, [None] * 9), doc_id=i, text=t, lang="en", source="a", n_chars=0)[c] for c in docs.columns) for i, t in odd]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    texts = encoder(queries.BYTE_BPE, queries.public_tokenizers.PATTERN)
    found = {(r.doc_id, tuple(r.ids)) for r in docs.filter("doc_id is null or doc_id in (3, 7)").collect()}
    for i, t in odd:
        if t and i != 7:
            assert (i, tuple(texts.encode(t))) in found
    assert any(i == 7 and len(ids) > 100_000 for i, ids in found)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        previous, docs = docs, common.staged(stage(spark, docs, sf_dir))
        out[name] = docs
        if name != "byte_bpe":
            assert docs.schema == previous.schema
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in previous.select("doc_id").collect()}
    toxic = {r.doc_id for r in queries.QUERIES["op6_toxicity"](spark, sf_dir).filter("predicted = 1").collect()}
    assert {r.doc_id for r in out["toxicity"].collect()} == set(before) - toxic
    lines = {r.doc_id: r for r in out["line_dedup"].collect()}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    from test_simhash import plain_components, plain_fingerprint

    groups = plain_components([(i, plain_fingerprint(r.text)) for i, r in lines.items()])
    unique = {r.doc_id: r for r in out["simhash_near_dedup"].collect()}
    assert set(unique) == {i for i, c in groups.items() if i == c}
    assert {r.doc_id: r.text for r in out["mix_to_targets"].collect()} == {i: r.text for i, r in unique.items()}
    assert out["mix_to_targets"].count() >= len(unique)
    coded = encoder(queries.BYTE_BPE, queries.public_tokenizers.PATTERN)
    assert all(r.ids == coded.encode(unique[r.doc_id].text) and r.n_tokens == len(r.ids) for r in out["byte_bpe"].collect())


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_components_match_search(spark):
    draw = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert found[start] == min(seen)
    assert len(found) == len(near)
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
