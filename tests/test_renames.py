"""Renames, volumes and event streams around a planted cutover."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from movecheck.operators import renames

CUT = date(2025, 4, 5)
SCHEMA = "platform string, name string, ts timestamp"
OPTIONS = dict(segment=["platform"], event="name", ts="ts", cutover=CUT)


def rows(platform, name, per_day, first, last):
    start = datetime(2025, 4, 5, 10)
    return [
        (platform, name, start + timedelta(days=d, minutes=i))
        for d in range(first, last)
        for i in range(per_day)
    ]


def events(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in rows(*p)], SCHEMA)


BASE = [
    ("ios", "session_start", 10, -20, 0),
    ("ios", "session_started", 9, 0, 12),
    ("android", "session_start", 15, -20, 12),
    ("ios", "feature_used", 3, -20, 12),
]


def detect(df, **kwargs):
    return renames.detect_renames(df, **{**OPTIONS, **kwargs})


def test_planted_rename_is_found(spark):
    found = detect(events(spark, *BASE)).collect()
    assert [tuple(r) for r in found] == [
        ("ios", "session_start", "session_started", 80, 72, 0.9, 1)
    ]


@pytest.mark.parametrize(
    "extra",
    [
        ("android", "session_started", 1, 3, 4),  # the new name is used elsewhere
        ("ios", "session_started", 1, -15, -14),  # the new name was there before
        ("ios", "session_start", 1, 9, 10),  # the old name is still in use, if later
    ],
)
def test_near_misses_are_not_renames(spark, extra):
    assert detect(events(spark, *BASE, extra)).count() == 0


@pytest.mark.parametrize("per_day,found", [(8, 1), (6, 1), (5, 0), (10, 1), (11, 0)])
def test_volume_tolerance_includes_its_bounds(spark, per_day, found):
    # 8 events a day before; 25 % either way is 6 to 10.
    df = events(spark, ("ios", "old", 8, -8, 0), ("ios", "new", per_day, 0, 8))
    assert detect(df).count() == found


def test_several_at_once_take_the_closest_then_the_first_name(spark):
    df = events(
        spark,
        ("ios", "a", 10, -8, 0), ("ios", "b", 20, -8, 0), ("ios", "lonely", 100, -8, 0),
        ("ios", "x9", 9, 0, 8), ("ios", "w11", 11, 0, 8), ("ios", "z20", 20, 0, 8), ("ios", "y20", 20, 0, 8),
    )
    got = {r.old_event: (r.new_event, r.candidates) for r in detect(df).collect()}
    assert got == {"a": ("w11", 2), "b": ("y20", 2)}


def test_thousands_of_names_stay_whole_and_small(spark):
    # 1500 names vanish and 1500 appear, all of one volume: every one has 1500 candidates.
    old = spark.range(1500).select(
        F.lit(None).cast("string").alias("platform"),
        F.format_string("old%05d", "id").alias("name"),
        F.lit(datetime(2025, 4, 4)).alias("ts"),
    )
    new = old.select(
        "platform", F.regexp_replace("name", "old", "new").alias("name"),
        F.lit(datetime(2025, 4, 6)).alias("ts"),
    )
    found = detect(old.unionByName(new))
    r = found.agg(F.count("*").alias("n"), F.min("candidates").alias("c"), F.max("new_event").alias("e")).first()
    assert tuple(r) == (1500, 1500, "new00000")


def test_detection_reads_the_events_once(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, *BASE).write.parquet(path)
    df = detect(spark.read.parquet(path))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "Cartesian" not in final


@pytest.mark.parametrize("tolerance", [0, 1])
def test_tolerance_is_checked(spark, tolerance):
    with pytest.raises(ValueError):
        detect(events(spark, *BASE), tolerance=tolerance)


def test_detected_rename_can_be_undone(spark):
    df = events(spark, *BASE)
    mapping = renames.canonical_mapping(detect(df), segment=["platform"], cutover=CUT)
    restored = renames.rename_events(df, mapping, segment=["platform"], event="name", ts="ts")
    names = {(r.platform, r.name): r["count"] for r in restored.groupBy("platform", "name").count().collect()}
    assert names == {
        ("ios", "session_start"): 200 + 108,
        ("android", "session_start"): 15 * 32,
        ("ios", "feature_used"): 96,
    }


def test_latest_reached_mapping_wins_and_nulls_match(spark):
    df = spark.createDataFrame(
        [(None, "a", datetime(2025, 1, d)) for d in (1, 5, 9)] + [("x", "a", datetime(2025, 1, 9)), (None, None, datetime(2025, 1, 9))],
        SCHEMA,
    )
    mapping = spark.createDataFrame(
        [(None, "a", "b", date(2025, 1, 5)), (None, "a", "c", date(2025, 1, 8))],
        "platform string, name string, renamed_to string, from_date date",
    )
    out = renames.rename_events(df, mapping, segment=["platform"], event="name", ts="ts")
    assert sorted(map(str, [(r.platform, r.ts.day, r.name) for r in out.collect()])) == sorted(
        map(str, [(None, 1, "a"), (None, 5, "b"), (None, 9, "c"), ("x", 9, "a"), (None, 9, None)])
    )
    assert out.columns == df.columns


def test_listed_mapping_equals_a_table_and_writes_nothing(spark, monkeypatch):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("platform"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("e"), F.col("id") % 7)).alias("name"),
        F.timestamp_add("DAY", (F.col("id") % 20).cast("int"), F.lit(datetime(2025, 1, 1))).alias("ts"),
    )
    mapping = [
        (None, "e1", "one", date(2025, 1, 5)),
        (None, "e1", "uno", date(2025, 1, 12)),
        ("p1", None, "unnamed", date(2025, 1, 1)),
        ("p2", "e3", None, date(2025, 1, 9)),
        ("p2", "e3", "three", date(2025, 1, 3)),
    ]
    how = dict(segment=["platform"], event="name", ts="ts")
    as_table = spark.createDataFrame(mapping, "platform string, name string, renamed_to string, from_date date")
    expected = renames.rename_events(df, as_table, **how).collect()
    monkeypatch.setattr(renames, "sized", None)  # nothing may be staged
    listed = renames.rename_events(df, mapping, **how)
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()
    assert listed.columns == df.columns and sorted(map(str, listed.collect())) == sorted(map(str, expected))
    assert renames.rename_events(df, [], **how).collect() == df.collect()
    same_day = [("p1", "e2", "x", date(2025, 1, 1)), ("p1", "e2", "y", date(2025, 1, 1))]
    assert "y" in {r.name for r in renames.rename_events(df, same_day, **how).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(renames, "LISTED", 1)  # a long list is a table
    assert sorted(map(str, renames.rename_events(df, mapping, **how).collect())) == sorted(map(str, expected))
    assert {r.name for r in renames.rename_events(df, same_day, **how).collect()} >= {"y"}


def test_mapping_beyond_the_broadcast_size_is_joined_all_the_same(spark, monkeypatch):
    from movecheck import session

    monkeypatch.setattr(session.sized, "__defaults__", (0, 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_latest_reached_mapping_wins_and_nulls_match(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_volume_conservation_counts_empty_days(spark):
    df = events(spark, ("ios", "a", 10, -8, 0), ("ios", "b", 10, 0, 8), ("web", "a", 8, -4, 0), ("web", "a", 2, 0, 8), ("new", "a", 1, 0, 8))
    out = renames.volume_conservation(df, segment=["platform"], ts="ts", cutover=CUT, days=8, tolerance=0.1)
    got = {r.platform: (r.pre_daily, r.post_daily, r.volume_ratio, r.conserved) for r in out.collect()}
    assert got == {"ios": (10, 10, 1, True), "web": (4, 2, 0.5, False), "new": (0, 1, None, False)}


def test_union_aligns_columns_and_sorts(spark):
    a = events(spark, ("ios", "a", 2, 0, 3))
    b = events(spark, ("web", "b", 2, 0, 3)).select("ts", "name", "platform")
    copies = a.limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("k")
    out = renames.union_streams([a, b, copies], order=["ts", "platform"])
    got = out.collect()
    assert out.columns == a.columns and len(got) == 62
    keys = [(r.ts, r.platform) for r in got]
    assert keys == sorted(keys)
    with pytest.raises(Exception, match="name"):
        renames.union_streams([a, b.drop("name")], order=["ts"])
