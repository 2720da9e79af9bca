"""Events that vanish, appear or change their name at a cutover date."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movecheck.functions.columns import all_of, ident, join_by, ratio
from movecheck.session import sized

#: Renamings given as tuples that become one expression; more of them are a table.
LISTED = 200


def _window_sums(day: Column, cutover: date, days: int) -> list[Column]:
    """Row counts before, just before, just after and after the cutover."""
    split = F.lit(cutover)
    first, last = F.date_sub(split, days), F.date_add(split, days)
    return [
        F.count_if(day < split).alias("before"),
        F.count_if((day >= first) & (day < split)).alias("pre"),
        F.count_if((day >= split) & (day < last)).alias("post"),
        F.count_if(day >= split).alias("after"),
    ]


def event_windows(
    events: DataFrame, *, segment: Sequence[str], event: str, ts: str, cutover: date, days: int
) -> DataFrame:
    """Counts per segment and event name around ``cutover``: one partial-aggregated pass.

    ``pre`` and ``post`` cover ``days`` days each side; ``before`` and ``after`` everything.
    """
    return events.groupBy(*[ident(c) for c in segment], ident(event).alias("event")).agg(
        *_window_sums(F.to_date(ident(ts)), cutover, days)
    )


def vanished_events(windows: DataFrame) -> DataFrame:
    """Events seen just before the cutover and never again in that segment."""
    # All four counts are named on both sides, although two are implied, so that both
    # filters sit on the same aggregate and the planner reuses one exchange.
    gone = (F.col("before") > 0) & (F.col("pre") > 0) & (F.col("post") == 0) & (F.col("after") == 0)
    return windows.filter(gone)


def appeared_events(windows: DataFrame, *, segment: Sequence[str]) -> DataFrame:
    """Events first seen just after the cutover and present in one segment only."""
    home = F.min(F.struct(*[ident(c) for c in segment])).alias("home")
    by_event = windows.groupBy("event").agg(
        F.count(F.lit(1)).alias("segments"),
        home,
        *[F.sum(c).alias(c) for c in ("before", "pre", "post", "after")],
    )
    new = (F.col("before") == 0) & (F.col("pre") == 0) & (F.col("post") > 0) & (F.col("after") > 0)
    return by_event.filter((F.col("segments") == 1) & new).select(
        *[F.col("home").getField(c).alias(c) for c in segment],
        "event", "before", "pre", "post", "after",
    )


def detect_renames(
    events: DataFrame,
    *,
    segment: Sequence[str],
    event: str,
    ts: str,
    cutover: date,
    days: int = 8,
    tolerance: float = 0.25,
) -> DataFrame:
    """Vanished events with the new event that took over their volume.

    A new event qualifies when it appears at the cutover, lives in this segment only, and
    its ``days``-day volume is within ``tolerance`` of the old event's volume over the
    same length before. One row per vanished event with a match: the closest volume wins,
    ties go to the alphabetically first name, and ``candidates`` counts all that qualify.

    Volumes are matched, not events: both sides first fold to their distinct volumes per
    segment. Distinct positive integers that add up to at most R rows number at most
    sqrt(2R), so the match stays small even where thousands of names change at once.
    Volumes meet on a logarithmic bucket as wide as the tolerance band, an equi-join.
    """
    if not 0 < tolerance < 1:
        raise ValueError("tolerance must lie strictly between 0 and 1")
    segment = list(segment)
    windows = event_windows(
        events, segment=segment, event=event, ts=ts, cutover=cutover, days=days
    )
    old = vanished_events(windows).select(
        *map(ident, segment), F.col("event").alias("old_event"), F.col("pre").alias("old_volume")
    )
    new = (
        appeared_events(windows, segment=segment)
        .groupBy(*map(ident, segment), F.col("post").alias("new_volume"))
        .agg(F.count(F.lit(1)).alias("names"), F.min("event").alias("new_event"))
    )
    width = math.log((1 + tolerance) / (1 - tolerance))

    def bucket(volume: Column, nudge: float = 0.0) -> Column:
        return F.floor(F.log(volume) / F.lit(width) + F.lit(nudge)).cast("int")

    # The nudge covers the last bit of the logarithm; the exact test below decides.
    low = bucket(F.col("old_volume") * (1 - tolerance), -1e-9)
    high = bucket(F.col("old_volume") * (1 + tolerance), 1e-9)
    volumes = (
        old.select(*map(ident, segment), "old_volume")
        .distinct()
        .withColumn("__bucket", F.explode(F.sequence(low, high)))
    )
    gap = F.abs(F.col("new_volume") - F.col("old_volume"))
    best = (
        join_by(
            volumes,
            new.withColumn("__bucket", bucket(F.col("new_volume"))),
            [*segment, "__bucket"],
        )
        .filter(gap <= F.lit(tolerance) * F.col("old_volume"))
        .groupBy(*map(ident, segment), "old_volume")
        .agg(
            F.min(F.struct(gap.alias("gap"), F.col("new_event"), F.col("new_volume"))).alias("best"),
            F.sum("names").alias("candidates"),
        )
    )
    return join_by(old, best, [*segment, "old_volume"]).select(
        *map(ident, segment),
        "old_event",
        F.col("best.new_event").alias("new_event"),
        "old_volume",
        F.col("best.new_volume").alias("new_volume"),
        ratio(F.col("best.new_volume"), F.col("old_volume")).alias("volume_ratio"),
        "candidates",
    )


def volume_conservation(
    events: DataFrame,
    *,
    segment: Sequence[str],
    ts: str,
    cutover: date,
    days: int,
    tolerance: float,
) -> DataFrame:
    """Mean events per day in the ``days`` days before and from the cutover, per segment.

    Days without events count as zero, so the means are window totals over ``days``. Only
    these days are read.
    """
    day = F.to_date(ident(ts))
    _, pre, post, _ = _window_sums(day, cutover, days)
    near = (day >= F.lit(cutover - timedelta(days))) & (day < F.lit(cutover + timedelta(days)))
    means = events.filter(near).groupBy(*[ident(c) for c in segment]).agg(pre, post)
    change = ratio(F.col("post"), F.col("pre"))
    return means.select(
        *[ident(c) for c in segment],
        (F.col("pre") / F.lit(float(days))).alias("pre_daily"),
        (F.col("post") / F.lit(float(days))).alias("post_daily"),
        change.alias("volume_ratio"),
        F.coalesce(F.abs(change - 1) <= tolerance, F.lit(False)).alias("conserved"),
    )


def _renamed_by_case(
    events: DataFrame, mapping: Sequence[tuple], segment: Sequence[str], event: str, ts: str
) -> DataFrame:
    """The renaming as one CASE over ``mapping``, latest date first: no join, nothing written."""
    day = F.to_date(ident(ts))
    keys = [*map(ident, segment), ident(event)]
    renamed = F.when(F.lit(False), F.lit(None).cast("string"))
    for *values, to, since in sorted((m for m in mapping if m[-1] is not None), key=lambda m: m[-1])[::-1]:
        applies = all_of(k.eqNullSafe(F.lit(v)) for k, v in zip(keys, values, strict=True))
        renamed = renamed.when(applies & (day >= F.lit(since)), F.lit(to))
    return events.withColumn(event, F.coalesce(renamed, ident(event)))


def rename_events(
    events: DataFrame, mapping: DataFrame | Sequence[tuple], *, segment: Sequence[str], event: str, ts: str
) -> DataFrame:
    """Rename events by segment and date.

    ``mapping`` has the segment columns, ``name``, ``renamed_to`` and ``from_date``
    (inclusive), as a table or as a list of tuples in this order. Where a name is mapped
    several times the latest date reached wins; in a list, the last of those with one date.

    Up to ``LISTED`` tuples become an expression and the call is lazy. A table is worked out
    once, written and counted (an action); a small one is broadcast, so the events do not
    move. A mapping beyond that size is joined by sort-merge, which adaptive execution splits
    where one event name dominates.
    """
    if not isinstance(mapping, DataFrame):
        if len(mapping) <= LISTED:
            return _renamed_by_case(events, mapping, segment, event, ts)
        kinds = [events.schema[c].dataType.simpleString() for c in segment]
        names = ", ".join(f"`{c}` {kind}" for c, kind in zip(segment, kinds))
        mapping = events.sparkSession.createDataFrame(
            list({(*m[:-2], m[-1]): m for m in mapping}.values()),
            f"{names}{', ' if names else ''}name string, renamed_to string, from_date date",
        )
    keys = [*segment, "__name"]
    ordered = Window.partitionBy(*[ident(c) for c in segment], F.col("name")).orderBy("from_date")
    spans = mapping.withColumn("__until", F.lead("from_date").over(ordered)).select(
        *[ident(c).alias(f"__m_{c}") for c in segment],
        F.col("name").alias("__m___name"),
        F.col("renamed_to").alias("__to"),
        F.col("from_date").alias("__from"),
        "__until",
    )
    spans = sized(spans)
    day = F.to_date(ident(ts))
    applies = (
        all_of(F.col(f"`{c}`").eqNullSafe(F.col(f"`__m_{c}`")) for c in keys)
        & (day >= F.col("__from"))
        & (F.col("__until").isNull() | (day < F.col("__until")))
    )
    return (
        events.withColumn("__name", ident(event))
        .join(spans, applies, "left")
        .withColumn(event, F.coalesce("__to", "__name"))
        .select(*[ident(c) for c in events.columns])
    )


def canonical_mapping(renames: DataFrame, *, segment: Sequence[str], cutover: date) -> DataFrame:
    """The mapping that undoes detected renames, for ``rename_events``."""
    return renames.select(
        *[ident(c) for c in segment],
        F.col("new_event").alias("name"),
        F.col("old_event").alias("renamed_to"),
        F.lit(cutover).alias("from_date"),
    )


def union_streams(streams: Sequence[DataFrame], *, order: Sequence[str]) -> DataFrame:
    """All event streams in one table, columns matched by name, globally sorted.

    A hash of the whole row and the input split follow the sort keys: rows that tie on
    every key, exact copies included, then spread over several range partitions.
    """
    merged = streams[0]
    for stream in streams[1:]:
        merged = merged.unionByName(stream)
    # Maps cannot be hashed; rows that differ in nothing else still spread by split.
    columns = [ident(c) for c, kind in merged.dtypes if "map<" not in kind]
    salted = merged.withColumn("__hash", F.xxhash64(*columns)).withColumn(
        "__split", F.spark_partition_id()
    )
    return salted.orderBy(*[ident(c) for c in order], "__hash", "__split").drop("__hash", "__split")
