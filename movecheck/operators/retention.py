"""Cohort retention, before/after comparison and the cohort at which a metric fell."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movecheck.functions.columns import ident, join_by, ratio


def first_seen(events: DataFrame, *, user: str, ts: str, cohort: str = "cohort") -> DataFrame:
    """One row per user with the date of their first event; events without a user are no one's."""
    known = events.filter(ident(user).isNotNull())
    return known.groupBy(ident(user).alias(user)).agg(
        F.to_date(F.min(ident(ts))).alias(cohort)
    )


def cohort_retention(
    users: DataFrame,
    events: DataFrame,
    *,
    user: str,
    cohort: str,
    ts: str,
    first_day: int,
    last_day: int,
    event: str | None = None,
    qualifying: Sequence[str] = (),
    by: Sequence[str] = (),
    window: tuple[date, date] | None = None,
) -> DataFrame:
    """Share of each segment's users active ``first_day``..``last_day`` after their cohort date.

    Both offsets are inclusive and count calendar days. ``qualifying`` names the events
    of column ``event`` that count; without it every event does. Users without events
    stay in the denominator. ``users`` holds one row per user. ``window`` keeps the cohorts
    between two dates (inclusive) and reads only the events that can count for them.

    Events shrink to distinct (user, day) before they meet the users, so a user with a
    third of all events contributes one row per active day to the join. Each active day
    knows the one before it; only the first inside a user's span joins. A user row thus
    meets at most one day, the left join keeps their number, and one pass over the users
    gives numerator and denominator.
    """
    if qualifying and event is None:
        raise ValueError("qualifying needs the name of the event column")
    kept = events.filter(ident(event).isin(*qualifying)) if qualifying else events
    if window:
        low, high = window
        users = users.filter(F.to_date(ident(cohort)).between(F.lit(low), F.lit(high)))
        kept = kept.filter(
            F.to_date(ident(ts)).between(
                F.lit(low + timedelta(first_day)), F.lit(high + timedelta(last_day))
            )
        )
    days = kept.select(ident(user).alias("__user"), F.to_date(ident(ts)).alias("__day")).distinct()
    # At most one row per calendar day and user in this window.
    by_day = Window.partitionBy("__user").orderBy("__day")
    active = days.withColumn("__previous", F.lag("__day").over(by_day))
    start = F.date_add(F.to_date(ident(cohort)), first_day)
    end = F.date_add(F.to_date(ident(cohort)), last_day)
    first_inside = (
        (ident(user) == F.col("__user"))
        & F.col("__day").between(start, end)
        & (F.col("__previous").isNull() | (F.col("__previous") < start))
    )
    totals = (
        users.join(active, first_inside, "left")
        .groupBy(*[ident(c) for c in by])
        .agg(F.count(F.lit(1)).alias("n"), F.count("__day").alias("retained"))
    )
    return totals.withColumn("rate", ratio(F.col("retained"), F.col("n")))


def complete_cohorts(
    users: DataFrame, *, cohort: str, last_day: int, events: DataFrame, ts: str
) -> DataFrame:
    """Keep cohorts whose last offset day is not after the last day seen in ``events``.

    The last day is a scalar subquery: one row, no join.
    """
    last_seen = events.agg(F.to_date(F.max(ident(ts)))).scalar()
    return users.filter(F.date_add(F.to_date(ident(cohort)), last_day) <= last_seen)


def before_after(
    rates: DataFrame, *, period: Column, early: str, late: str, by: Sequence[str] = ()
) -> DataFrame:
    """Fold (n, retained) counts into one early/late contrast row per segment.

    ``period`` labels each row ``early``, ``late`` or something else (left out).
    ``change`` is late − early; ``relative_drop`` is (early − late) / early.
    """

    def total(column: str, label: str) -> Column:
        return F.coalesce(F.sum(F.when(period == label, F.col(column))), F.lit(0)).cast("bigint")

    folded = rates.groupBy(*[ident(c) for c in by]).agg(
        total("n", early).alias("n_early"),
        total("retained", early).alias("retained_early"),
        total("n", late).alias("n_late"),
        total("retained", late).alias("retained_late"),
    )
    rated = folded.withColumn(
        "rate_early", ratio(F.col("retained_early"), F.col("n_early"))
    ).withColumn("rate_late", ratio(F.col("retained_late"), F.col("n_late")))
    change = F.col("rate_late") - F.col("rate_early")
    return rated.withColumn("change", change).withColumn(
        "relative_drop", ratio(-change, F.col("rate_early"))
    )


def cohort_onset(
    rates: DataFrame, *, cohort: str, trailing: int, drop: float, by: Sequence[str] = ()
) -> DataFrame:
    """First cohort whose rate is at least ``drop`` below the ``trailing`` cohorts before it.

    ``rates`` holds (n, retained) per segment and cohort. The baseline pools the counts
    of the preceding cohorts; cohorts with fewer than ``trailing`` predecessors are not
    judged. Segments that never fall keep a row with a null onset.

    The window runs over cohort dates, already aggregated: at most one row per calendar
    day and segment, whatever the number of users.
    """
    segments = [ident(c) for c in by]
    before = (
        Window.partitionBy(*(segments or [F.lit(0)]))
        .orderBy(ident(cohort))
        .rowsBetween(-trailing, -1)
    )
    judged = (
        rates.withColumn("__seen", F.count(F.lit(1)).over(before))
        .withColumn(
            "__baseline", ratio(F.sum("retained").over(before), F.sum("n").over(before))
        )
        .withColumn("__rate", ratio(F.col("retained"), F.col("n")))
        .withColumn("__drop", ratio(F.col("__baseline") - F.col("__rate"), F.col("__baseline")))
    )
    fell = (F.col("__seen") == trailing) & (F.col("__drop") >= drop)
    first = F.min(
        F.when(
            fell,
            F.struct(
                ident(cohort).alias("onset"),
                F.col("__rate").alias("onset_rate"),
                F.col("__baseline").alias("baseline_rate"),
                F.col("__drop").alias("onset_drop"),
            ),
        )
    )
    return (
        judged.groupBy(*segments)
        .agg(F.count(F.lit(1)).alias("cohorts"), first.alias("__first"))
        .select(*segments, "cohorts", "__first.*")
    )


def onset_against_changes(
    onsets: DataFrame, changes: DataFrame, *, changed_on: str, on: Sequence[str]
) -> DataFrame:
    """Set each onset against the change log of its segment.

    ``timing`` is ``before change`` when the metric was already down before the change
    (so the change cannot be the cause), ``after change`` otherwise, ``no onset`` when it
    never fell and ``no change`` when the log holds nothing for the segment.
    """
    joined = join_by(onsets, changes, on, "left")
    timing = (
        F.when(ident(changed_on).isNull(), "no change")
        .when(F.col("onset").isNull(), "no onset")
        .when(F.col("onset") < ident(changed_on), "before change")
        .otherwise("after change")
    )
    return joined.withColumn("timing", timing)
