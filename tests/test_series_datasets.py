"""Daily series, key audits, equality, ranks and allocation."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from movecheck.operators import datasets, series

START = date(2025, 1, 6)


@pytest.fixture(scope="module")
def spend(spark):
    """Two channels, 120 days, spend at 45 % on days 88 to 95."""
    rows = [
        (START + timedelta(days=i), channel, base * (0.45 if 87 <= i <= 94 else 1.0))
        for i in range(120)
        for channel, base in (("search", 1200.0), ("social", 800.0))
    ]
    return spark.createDataFrame(rows, "day date, channel string, spend double")


def test_dip_against_neighbours(spend):
    daily = series.daily_totals(spend, ts="day", value=F.col("spend"))
    dip = dict(start=START + timedelta(days=87), end=START + timedelta(days=94))
    r = series.dip_against_neighbours(daily, **dip).first()
    assert (r.mean_before, r.mean_after, r.dip_ratio) == pytest.approx((2000, 2000, 0.45))
    by = series.daily_totals(spend, ts="day", value=F.col("spend"), by=["channel"])
    got = {r.channel: r.dip_ratio for r in series.dip_against_neighbours(by, **dip, by=["channel"]).collect()}
    assert got == pytest.approx({"search": 0.45, "social": 0.45})


def test_index_to_median(spend):
    daily = series.daily_totals(spend, ts="day", value=F.col("spend"))
    got = {round(r.day_index, 6) for r in series.index_to_median(daily).collect()}
    assert got == {1.0, 0.45}
    by = series.daily_totals(spend, ts="day", value=F.col("spend"), by=["channel"])
    assert {round(r.day_index, 6) for r in series.index_to_median(by, by=["channel"]).collect()} == {1.0, 0.45}


def test_mix_share_keeps_null_groups(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), (None, None)], "g string, c string"
    )
    got = {(r.g, r.c): r.share for r in series.mix_share(df, category="c", by=["g"]).collect()}
    assert got == pytest.approx(
        {("a", "x"): 2 / 3, ("a", "y"): 1 / 3, (None, "x"): 0.5, (None, None): 0.5}
    )
    got = {r.c: r.share for r in series.mix_share(df, category="c").collect()}
    assert got == pytest.approx({"x": 0.6, "y": 0.2, None: 0.2})


def test_mix_shift_with_an_empty_baseline(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1)], "c string, p int")
    rows = series.mix_shift(df, category="c", focus=F.col("p") == 1, baseline=F.col("p") == 0).collect()
    assert {(r.c, r.focus_share, r.baseline_share) for r in rows} == {("x", 0.5, None), ("y", 0.5, None)}


def test_key_audit_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, date(2025, 1, 2)), (2, date(2025, 1, 1)), (2, date(2025, 1, 3))], "k int, d date"
    )
    assert tuple(datasets.key_audit(df, key=["k"], ts="d").first()) == (
        3, 2, date(2025, 1, 1), date(2025, 1, 3), False,
    )
    assert [tuple(r) for r in datasets.duplicate_keys(df, key=["k"]).collect()] == [(2, 2)]


def test_equality_counts_copies_and_ignores_order(spark):
    nan = float("nan")
    left = spark.createDataFrame([(1, "a", nan), (1, "a", nan), (2, None, 0.0)], "i int, s string, d double")
    same = left.repartition(3).select("d", "i", "s")
    assert tuple(datasets.dataset_equality(left, same).first()) == (0, 0, True)
    fewer = spark.createDataFrame([(1, "a", nan), (2, None, 0.0), (3, "c", 1.0)], left.schema)
    assert tuple(datasets.dataset_equality(left, fewer).first()) == (1, 1, False)
    assert datasets.fingerprint(left).first() == datasets.fingerprint(same).first()
    assert datasets.fingerprint(left).first() != datasets.fingerprint(fewer).first()
    with pytest.raises(ValueError):
        datasets.dataset_diff(left, left.drop("s"))


@pytest.mark.parametrize("buckets", [7, 16_384])
def test_diff_by_buckets_equals_counting_all_rows(spark, monkeypatch, buckets):
    monkeypatch.setattr(datasets, "BUCKETS", buckets)
    rng = random.Random(5)
    kinds = "k bigint, s string, d double, a array<int>"

    def row(i):
        return (i % 90, rng.choice(["x", "", None]), rng.choice([0.0, -0.0, float("nan"), None, 1.5]), [i % 2])

    kept = [row(i) for i in range(600)] + [(7, "hot", 1.0, None)] * 400
    left = spark.createDataFrame(kept + [row(i) for i in range(40)], kinds)
    right = spark.createDataFrame(kept[:-3] + [(-1, None, None, None)] * 2, kinds).select("d", "a", "s", "k")
    for one, two in ((left, right), (left, right.limit(0)), (left.limit(0), right), (left, left.repartition(5))):
        expected = Counter()
        for table, sign in ((one, 1), (two, -1)):
            for r in table.select("k", "s", (F.col("d") + 0.0).cast("string").alias("d"), "a").collect():
                expected[str(r)] += sign
        found = datasets.dataset_diff(one, two)
        columns = ["k", "s", (F.col("d") + 0.0).cast("string").alias("d"), "a"]
        got = {
            str(r[0]): r.n
            for r in found.select(F.struct(*columns), (F.col("left_n") - F.col("right_n")).alias("n")).collect()
        }
        assert got == {r: n for r, n in expected.items() if n}
        assert found.columns == [*one.columns, "left_n", "right_n"]


def test_diff_of_equal_tables_moves_the_bucket_table_only(spark, tmp_path):
    spark.range(50_000).select("id", F.repeat(F.lit("text"), 50).alias("t")).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    found = datasets.dataset_diff(one, one.orderBy(F.col("id").desc()))
    assert found.collect() == []
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # What is left of the grouping of whole rows: no exchange, nothing to read.
    assert "EmptyRelation" in final and "Exchange" not in final.split("EmptyRelation")[0]


def test_diff_with_maps(spark):
    df = spark.sql("SELECT map('a', id) AS m FROM range(3)")
    assert datasets.dataset_equality(df, df).first().identical
    assert datasets.dataset_diff(df, df.limit(2)).count() == 1


def test_rank_within_equals_a_window_on_a_hot_group(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        (F.xxhash64("id") % 7).alias("v"),
    )
    ranked = datasets.rank_within(df, by=["g"], order=[F.col("v").desc(), F.col("id")])
    # Spread over several splits, the hot group included.
    assert datasets.rank_within(df, by=[], order=[F.col("id")], name="n").filter("n = id + 1").count() == 3000
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    expected = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    assert datasets.dataset_equality(ranked, expected).first().identical


def brute_allocation(weights, total):
    s = sum(w for _, w in weights)
    units = {k: w * total // s for k, w in weights}
    left = total - sum(units.values())
    for k, _ in sorted(weights, key=lambda e: (-(e[1] * total % s), e[0]))[:left]:
        units[k] += 1
    return units


def test_allocation_against_brute_force(spark):
    rng = random.Random(5)
    groups = {g: [(k, rng.randrange(0, 9)) for k in range(rng.randrange(3, 60))] for g in "abc"}
    groups["equal"] = [(k, 1) for k in range(3)]
    groups["zero"] = [(0, 0), (1, 0)]
    rows = [(g, k, w) for g, e in groups.items() for k, w in e]
    df = spark.createDataFrame(rows, "g string, k int, w int")
    out = datasets.allocate(df, weight="w", total=10, key=["k"], by=["g"]).collect()
    got = {g: {r.k: r.units for r in out if r.g == g} for g in groups}
    assert got["equal"] == {0: 4, 1: 3, 2: 3}
    assert got["zero"] == {0: None, 1: None}
    for g in "abc":
        assert got[g] == brute_allocation(groups[g], 10) and sum(got[g].values()) == 10


def test_allocation_of_fractions_without_groups(spark):
    df = spark.createDataFrame([(k, 0.1 + k / 7) for k in range(120)], "k int, w double")
    out = datasets.allocate(df, weight="w", total=50_000, key=["k"])
    assert out.agg(F.sum("units")).first()[0] == 50_000
    total = sum(0.1 + k / 7 for k in range(120))
    for r in out.collect():
        assert abs(r.units - r.w * 50_000 / total) < 1
