"""Daily series: mix shares, dips against neighbouring weeks, index to the median."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movecheck.functions.columns import ident, join_by, ratio


def mix_share(df: DataFrame, *, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows per category, within each ``by`` group.

    Totals are summed from the category counts and joined back (or read as a scalar
    subquery without ``by``) instead of a window, which would bring all categories of
    a group into one task.
    """
    counts = df.groupBy(*[ident(c) for c in by], ident(category).alias(category)).agg(
        F.count(F.lit(1)).alias("n")
    )
    if not by:
        total = counts.agg(F.sum("n")).scalar()
        return counts.withColumn("share", ratio(F.col("n"), total))
    totals = counts.groupBy(*[ident(c) for c in by]).agg(F.sum("n").alias("__total"))
    return (
        join_by(counts, totals, by)
        .withColumn("share", ratio(F.col("n"), F.col("__total")))
        .drop("__total")
    )


def mix_shift(df: DataFrame, *, category: str, focus: Column, baseline: Column) -> DataFrame:
    """Share per category in the focus and the baseline rows, and the difference.

    Rows in neither are filtered first, so date ranges reach the scan.
    """
    counts = df.filter(focus | baseline).groupBy(ident(category).alias(category)).agg(
        F.count_if(focus).alias("n_focus"), F.count_if(baseline).alias("n_baseline")
    )
    totals = counts.agg(
        F.struct(F.sum("n_focus").alias("focus"), F.sum("n_baseline").alias("baseline"))
    ).scalar()
    shares = counts.withColumn(
        "focus_share", ratio(F.col("n_focus"), totals.getField("focus"))
    ).withColumn("baseline_share", ratio(F.col("n_baseline"), totals.getField("baseline")))
    return shares.withColumn("share_shift", F.col("focus_share") - F.col("baseline_share"))


def daily_totals(df: DataFrame, *, ts: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` per day and group."""
    return df.groupBy(*[ident(c) for c in by], F.to_date(ident(ts)).alias("day")).agg(
        F.sum(value).alias("total")
    )


def dip_against_neighbours(
    daily: DataFrame, *, start: date, end: date, days: int = 7, by: Sequence[str] = ()
) -> DataFrame:
    """Mean daily total inside ``start``..``end`` against the ``days`` days on either side.

    ``dip_ratio`` is the dip mean over the average of the two neighbour means. Days
    without rows are not in ``daily`` and so not in a mean. Only the days compared are
    kept, a filter that reaches the scan below ``daily``.
    """
    day = F.col("day")
    one = timedelta(days=1)

    def mean(first: date, last: date) -> Column:
        return F.avg(F.when(day.between(F.lit(first), F.lit(last)), F.col("total")))

    compared = day.between(F.lit(start - days * one), F.lit(end + days * one))
    means = daily.filter(compared).groupBy(*[ident(c) for c in by]).agg(
        mean(start, end).alias("dip_mean"),
        mean(start - days * one, start - one).alias("mean_before"),
        mean(end + one, end + days * one).alias("mean_after"),
    )
    neighbours = (F.col("mean_before") + F.col("mean_after")) / 2
    return means.withColumn("dip_ratio", ratio(F.col("dip_mean"), neighbours))


def index_to_median(daily: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Each day's total over the median daily total of its group (exact median).

    The median sees one number per calendar day and group, never the raw rows.
    """
    if not by:
        middle = daily.agg(F.median("total")).scalar()
        return daily.withColumn("day_index", ratio(F.col("total"), middle))
    middles = daily.groupBy(*[ident(c) for c in by]).agg(F.median("total").alias("__median"))
    return (
        join_by(daily, middles, by)
        .withColumn("day_index", ratio(F.col("total"), F.col("__median")))
        .drop("__median")
    )
