"""Retention, contrasts over cohorts and onsets on small hand-made tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from movecheck.operators import retention

USERS = "user_id long, signup date, platform string"
EVENTS = "user_id long, ts timestamp, name string"
DAY = date(2025, 1, 6)


def at(days, hour=12):
    return datetime(2025, 1, 6, hour) + timedelta(days=days)


@pytest.fixture(scope="module")
def warehouse(spark):
    users = spark.createDataFrame(
        [(1, DAY, "ios"), (2, DAY, "ios"), (3, DAY, "web"), (4, DAY, None), (5, DAY, "web")], USERS
    )
    events = spark.createDataFrame(
        [
            (1, at(7, 0), "start"),  # first day, first hour
            (2, at(13, 23), "start"),  # last day, last hour
            (3, at(14, 0), "start"),  # a day late
            (3, at(6, 23), "start"),  # a day early
            (4, at(8), "other"),  # not a qualifying event
            (4, at(9), "start"),
            (None, at(9), "start"),
        ]
        + [(1, at(8), "start")] * 500,
        EVENTS,
    )
    return users, events


def rates(users, events, **kwargs):
    options = dict(
        user="user_id", cohort="signup", ts="ts", event="name", qualifying=["start"], first_day=7, last_day=13
    )
    return retention.cohort_retention(users, events, **{**options, **kwargs})


def test_offsets_are_inclusive_calendar_days(warehouse):
    row = rates(*warehouse).first()
    assert (row.n, row.retained, row.rate) == (5, 3, 0.6)


def test_segments_keep_null_and_users_without_events(warehouse):
    rows = {r.platform: (r.n, r.retained) for r in rates(*warehouse, by=["platform"]).collect()}
    assert rows == {"ios": (2, 2), "web": (2, 0), None: (1, 1)}


def test_any_event_counts_without_a_list(warehouse):
    users, events = warehouse
    assert rates(users, events, qualifying=()).first().retained == 3


def test_qualifying_needs_its_column(warehouse):
    with pytest.raises(ValueError):
        rates(*warehouse, event=None)


def test_empty_users_give_a_zero_row(spark, warehouse):
    row = rates(spark.createDataFrame([], USERS), warehouse[1]).first()
    assert (row.n, row.retained, row.rate) == (0, 0, None)


def test_partitioning_does_not_matter(warehouse):
    users, events = warehouse
    one = rates(users.coalesce(1), events.coalesce(1), by=["platform"]).collect()
    many = rates(users.repartition(7), events.repartition(9), by=["platform"]).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_plan_joins_on_the_user_key(warehouse):
    plan = rates(*warehouse)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_window_keeps_cohorts_and_prunes_the_scan(spark, warehouse, tmp_path):
    users, events = warehouse
    late = users.union(spark.createDataFrame([(6, DAY + timedelta(days=1), "ios")], USERS))
    path = str(tmp_path / "events")
    events.write.parquet(path)
    df = rates(late, spark.read.parquet(path), window=(DAY, DAY))
    row = df.first()
    assert (row.n, row.retained) == (5, 3)
    plan = df._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(ts,2025-01-13" in line for line in pushed), plan


def test_complete_cohorts(spark, warehouse):
    users = spark.createDataFrame([(1, DAY, "ios"), (2, DAY + timedelta(days=2), "ios")], USERS)
    kept = retention.complete_cohorts(users, cohort="signup", last_day=13, events=warehouse[1], ts="ts")
    assert [r.user_id for r in kept.collect()] == [1]  # the last event is on day 14


def test_first_seen(warehouse):
    rows = {r.user_id: r.cohort for r in retention.first_seen(warehouse[1], user="user_id", ts="ts").collect()}
    assert rows == {1: at(7).date(), 2: at(13).date(), 3: at(6).date(), 4: at(8).date()}


def test_before_after(spark):
    counts = spark.createDataFrame(
        [("ios", "early", 100, 40), ("ios", "late", 50, 10), ("ios", "gap", 9, 9), ("web", "early", 10, 5)],
        "platform string, period string, n long, retained long",
    )
    rows = retention.before_after(
        counts, period=F.col("period"), early="early", late="late", by=["platform"]
    ).collect()
    got = {r.platform: r for r in rows}
    assert got["ios"].change == pytest.approx(-0.2) and got["ios"].relative_drop == pytest.approx(0.5)
    assert got["web"].n_late == 0 and got["web"].rate_late is None and got["web"].change is None


@pytest.fixture(scope="module")
def onsets(spark):
    rows = []
    for i in range(8):
        day = DAY + timedelta(days=i)
        rows += [("ios", day, 100, 40 if i < 5 else 20), ("web", day, 100, 40), ("new", day, 0, 0)]
    series = spark.createDataFrame(rows, "platform string, cohort date, n long, retained long")
    return retention.cohort_onset(series, cohort="cohort", trailing=3, drop=0.25, by=["platform"])


def test_onset(onsets):
    rows = {r.platform: r for r in onsets.collect()}
    assert rows["ios"].onset == DAY + timedelta(days=5) and rows["ios"].cohorts == 8
    assert (rows["ios"].onset_rate, rows["ios"].baseline_rate) == (0.2, 0.4)
    assert rows["web"].onset is None and rows["new"].onset is None


def test_onset_without_segments(spark):
    series = spark.createDataFrame(
        [(DAY + timedelta(days=i), 10, 5 if i != 3 else 1) for i in range(5)], "c date, n long, retained long"
    )
    row = retention.cohort_onset(series, cohort="c", trailing=2, drop=0.5).first()
    assert row.onset == DAY + timedelta(days=3)


def test_changes_after_the_onset_cannot_be_the_cause(spark, onsets):
    changes = spark.createDataFrame(
        [("ios", DAY + timedelta(days=6)), ("ios", DAY + timedelta(days=4)), ("web", DAY)],
        "platform string, day date",
    )
    rows = retention.onset_against_changes(onsets, changes, changed_on="day", on=["platform"]).collect()
    timing = sorted((r.platform, str(r.day), r.timing) for r in rows)
    assert timing == [
        ("ios", "2025-01-10", "after change"),
        ("ios", "2025-01-12", "before change"),
        ("new", "None", "no change"),
        ("web", "2025-01-06", "no onset"),
    ]
