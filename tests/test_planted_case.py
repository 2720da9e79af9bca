"""A whole investigation on a warehouse with a planted rename: does the engine find the truth?

50,000 users over 120 days, retention 0.32 on days 7-13 in every cohort. From day 90 one
platform's qualifying event is written under another name; spend dips and a flag flips
around the same time and have nothing to do with it.
"""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from movecheck.operators import audits, contrasts, datasets, renames, retention, series

DAY1 = date(2025, 1, 6)
CUT = DAY1 + timedelta(days=89)
FLAG = DAY1 + timedelta(days=88)
EARLY, LATE = DAY1 + timedelta(days=75), DAY1 + timedelta(days=82)
PER_DAY = 1.0 - 0.68 ** (1.0 / 7.0)


def uniform(*columns):
    """A repeatable number in 0..1 from the given columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / F.lit(1_000_003.0)


@pytest.fixture(scope="module")
def warehouse(spark):
    platform = uniform("user_id", F.lit("platform"))
    users = spark.range(1, 50_001).select(
        F.col("id").cast("int").alias("user_id")
    ).withColumn("offset", (uniform("user_id", F.lit("day")) * 120).cast("int")).select(
        "user_id",
        F.date_add(F.lit(DAY1), F.col("offset")).alias("signup_date"),
        F.when(platform < 0.30, "ios").when(platform < 0.85, "android").otherwise("web").alias("platform"),
    )
    day = F.date_add("signup_date", F.col("after"))
    chance = F.when(F.col("after").between(7, 13), PER_DAY).otherwise(0.02)
    sessions = (
        users.withColumn("after", F.explode(F.sequence(F.lit(1), F.lit(27))))
        .withColumn("day", day)
        .filter((F.col("day") < F.lit(DAY1 + timedelta(days=120))) & (uniform("user_id", "after") < chance))
        .select(
            "user_id",
            F.timestamp_seconds(F.unix_date("day") * 86400 + 3600 * 8).alias("event_ts"),
            F.when((F.col("platform") == "ios") & (F.col("day") >= F.lit(CUT)), "session_started")
            .otherwise("session_start")
            .alias("event_name"),
            "platform",
        )
    )
    signups = users.select(
        "user_id",
        F.to_timestamp("signup_date").alias("event_ts"),
        F.lit("signup_completed").alias("event_name"),
        "platform",
    )
    users, events = users.cache(), renames.union_streams([signups, sessions], order=["event_ts", "user_id"]).cache()
    yield users, events
    users.unpersist(), events.unpersist()


def rates(users, events, by):
    complete = retention.complete_cohorts(
        users, cohort="signup_date", last_day=13, events=events, ts="event_ts"
    )
    return retention.cohort_retention(
        complete, events, user="user_id", cohort="signup_date", ts="event_ts", event="event_name",
        qualifying=["session_start"], first_day=7, last_day=13, by=by,
    )


def early_late(users, events, by=(), late=LATE):
    signup = F.col("signup_date")
    period = F.when(signup < F.lit(EARLY), "early").when(signup >= F.lit(late), "late")
    return retention.before_after(
        rates(users.withColumn("period", period), events, [*by, "period"]),
        period=F.col("period"), early="early", late="late", by=by,
    )


def test_shape(warehouse):
    users, _ = warehouse
    audit = datasets.key_audit(users, key=["user_id"], ts="signup_date").first()
    assert audit.is_key and audit.n_rows == 50_000
    assert (audit.first_day, audit.last_day) == (DAY1, DAY1 + timedelta(days=119))
    mix = {r.platform: r.share for r in series.mix_share(users, category="platform").collect()}
    assert mix == pytest.approx({"ios": 0.30, "android": 0.55, "web": 0.15}, abs=0.02)


def test_blended_retention_falls_and_android_stays(warehouse):
    blended = early_late(*warehouse).first()
    assert blended.rate_early == pytest.approx(0.32, abs=0.02)
    assert blended.relative_drop >= 0.25
    by = {r.platform: r for r in early_late(*warehouse, by=["platform"], late=EARLY).collect()}
    assert abs(by["android"].change) < 0.02 and by["ios"].relative_drop > 0.5


def test_only_ios_is_significant(warehouse):
    arms = early_late(*warehouse, by=["platform"]).select(
        "platform",
        F.col("retained_early").alias("a_success"), F.col("n_early").alias("a_n"),
        F.col("retained_late").alias("b_success"), F.col("n_late").alias("b_n"),
    )
    got = {r.platform: r for r in contrasts.two_prop_from_counts(arms, alpha=0.01, by=["platform"]).collect()}
    assert got["ios"].p_value < 1e-12 and got["ios"].ci_low > 0.1
    assert got["android"].ci_low < 0 < got["android"].ci_high


def test_the_rename_is_found_volumes_hold_and_undoing_it_restores_retention(warehouse):
    users, events = warehouse
    options = dict(segment=["platform"], ts="event_ts", cutover=CUT)
    found = renames.detect_renames(events, event="event_name", **options)
    assert [(r.platform, r.old_event, r.new_event) for r in found.collect()] == [
        ("ios", "session_start", "session_started")
    ]
    flat = renames.volume_conservation(events, days=8, tolerance=0.1, **options)
    assert {r.platform: r.conserved for r in flat.collect()} == {"ios": True, "android": True, "web": True}
    mapping = renames.canonical_mapping(found, segment=["platform"], cutover=CUT)
    fixed = renames.rename_events(events, mapping, segment=["platform"], event="event_name", ts="event_ts")
    restored = early_late(users, fixed).first()
    assert abs(restored.change) < 0.02


def test_onset_comes_before_the_flag(spark, warehouse):
    by_day = rates(*warehouse, ["platform", "signup_date"])
    onset = retention.cohort_onset(by_day, cohort="signup_date", trailing=14, drop=0.5, by=["platform"])
    flag = spark.createDataFrame([(p, FLAG) for p in ("ios", "android", "web")], "platform string, flipped date")
    got = {
        r.platform: r
        for r in retention.onset_against_changes(onset, flag, changed_on="flipped", on=["platform"]).collect()
    }
    assert got["ios"].timing == "before change"
    # The first cohorts whose span reaches the cutover signed up 13 days before it.
    assert CUT - timedelta(days=13) <= got["ios"].onset < FLAG
    assert got["android"].timing == "no onset"


def test_daily_contrast_sees_ios_fall(warehouse):
    _, events = warehouse
    day = F.to_date("event_ts")
    daily = (
        events.filter((F.col("event_name") == "session_start") & day.between(F.lit(CUT - timedelta(20)), F.lit(CUT + timedelta(20))))
        .groupBy(day.alias("day"), "platform")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .filter("platform <> 'web'")
        .withColumn("g", (F.col("platform") == "ios").cast("int"))
        .withColumn("p", (F.col("day") >= F.lit(CUT)).cast("int"))
    )
    # iOS has no row at all after the cutover: an empty cell, so no estimate.
    r = contrasts.did(daily, metric="n_events", group="g", period="p", alpha=0.05).first()
    assert r.valid and r.n_treat_post == 0 and r.estimate is None
    both = F.explode(F.array(F.lit("ios"), F.lit("android")))
    full = (
        daily.select("day", "p").distinct().withColumn("platform", both)
        .join(daily.select("day", "platform", "n_events"), ["day", "platform"], "left")
        .fillna(0, ["n_events"])
        .withColumn("g", (F.col("platform") == "ios").cast("int"))
    )
    r = contrasts.did(full, metric="n_events", group="g", period="p", alpha=0.05).first()
    assert r.valid and r.nobs == 82 and r.estimate < -50 and r.p_value < 1e-10


def test_the_answer_passes_its_own_audit(warehouse):
    by_day = rates(*warehouse, ["signup_date"]).withColumnRenamed("signup_date", "d")
    row = audits.audit_row(
        by_day, focus=("2025-03-23", "2025-04-21"), date_range=("2025-01-06", "2025-05-05"),
        source_counts={"users": 50_000}, is_aggregate=True,
    ).first()
    assert row.status == "pass" and row.row_count == 107
