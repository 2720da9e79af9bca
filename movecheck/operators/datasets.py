"""Whole-table questions: key audits, equality, ranks and proportional allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movecheck.functions.columns import ident, join_by
from movecheck.session import checkpointed, sized

#: Hash buckets per level in which two tables are compared; the bucket table has no more rows.
BUCKETS = 16_384
_WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def key_audit(df: DataFrame, *, key: Sequence[str], ts: str) -> DataFrame:
    """Rows, distinct keys and date range in one pass. Null keys are not distinct keys."""
    audit = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(*[ident(c) for c in key]).alias("n_keys"),
        F.to_date(F.min(ident(ts))).alias("first_day"),
        F.to_date(F.max(ident(ts))).alias("last_day"),
    )
    return audit.withColumn("is_key", F.col("n_rows") == F.col("n_keys"))


def duplicate_keys(df: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their number of rows."""
    return (
        df.groupBy(*[ident(c) for c in key])
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def dataset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``left_n`` and ``right_n``.

    Only rows of hash buckets in which the two sides differ are grouped row by row, so
    equal tables move nothing but a bucket table. Copies are counted before the shuffle and
    never spelled out again, however many there are. Empty tables and nulls compare like
    any others. Maps have no hash: a table with one is grouped whole.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    columns = [ident(c) for c in left.columns]
    tagged = left.select(*columns, F.lit(1).alias("left_n"), F.lit(0).alias("right_n")).unionByName(
        right.select(*columns, F.lit(0).alias("left_n"), F.lit(1).alias("right_n"))
    )
    if not any(_holds_map(f.dataType) for f in tagged.schema):
        tagged = _suspects(tagged, columns)
    counted = tagged.groupBy(*columns).agg(
        F.sum("left_n").alias("left_n"), F.sum("right_n").alias("right_n")
    )
    return counted.filter(F.col("left_n") != F.col("right_n"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def _suspects(tagged: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows in hash buckets whose sides differ in number of rows or in the sums of two hashes.

    Two levels: the buckets that differ are cut again by the second hash, the finer the
    fewer they are. Either level has at most ``BUCKETS`` rows, which bounds what is broadcast.
    A bucket that differs passes for equal only if both 64-bit sums agree by chance.
    """
    hashes = {"__first": F.xxhash64(*columns), "__second": F.xxhash64(F.lit(BUCKETS), *columns)}
    ours = F.col("left_n") > 0

    def uneven(rows: DataFrame, *keys: str) -> DataFrame:
        sums = {"__rows": F.sum(F.col("left_n") - F.col("right_n"))}
        for name in hashes:
            value = F.col(name).cast("decimal(28,0)")
            sums[name] = F.sum(F.when(ours, value).otherwise(-value))
        found = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
        return found.filter(" or ".join(f"{k} <> 0" for k in sums)).select(*keys)

    marked = tagged.withColumns(hashes).withColumn("__bucket", F.pmod("__first", F.lit(BUCKETS)))
    all_of_them = Window.partitionBy(F.lit(0))  # at most BUCKETS rows
    coarse = uneven(marked, "__bucket").withColumn(
        "__parts", F.call_function("div", F.lit(BUCKETS), F.count(F.lit(1)).over(all_of_them))
    )
    near = marked.join(F.broadcast(coarse), "__bucket").withColumn(
        "__part", F.pmod("__second", F.col("__parts"))
    )
    fine = uneven(near, "__bucket", "__part")
    return near.join(F.broadcast(fine), ["__bucket", "__part"], "left_semi")


def dataset_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows (copies counted) only one side has, and whether none do."""
    extra = F.col("left_n") - F.col("right_n")
    return (
        dataset_diff(left, right)
        .agg(
            F.coalesce(F.sum(F.greatest(extra, F.lit(0))), F.lit(0)).alias("only_left"),
            F.coalesce(F.sum(F.greatest(-extra, F.lit(0))), F.lit(0)).alias("only_right"),
        )
        .withColumn("identical", (F.col("only_left") == 0) & (F.col("only_right") == 0))
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free content hash: equality of huge tables without a shuffle.

    Different fingerprints prove a difference; equal ones make it a matter of 64-bit luck.
    """
    columns = [ident(c) for c in sorted(df.columns)]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("content_hash"),
    )


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range-sorted on (by, order) with every row's position written down (an action).

    Positions count up within a split of the sort and between splits; the checkpoint
    fixes them, so a recomputed split cannot renumber its rows.
    """
    return checkpointed(
        df.orderBy(*[ident(c) for c in by], *order)
        .withColumn("__position", F.monotonically_increasing_id())
        .withColumn("__split", F.shiftright(F.col("__position"), 33))
    )


def _ranked(placed: DataFrame, by: Sequence[str], name: str, total: str | None = None) -> DataFrame:
    """Turns positions into ranks: one small row per group and split is joined back.

    With ``total`` the group's sum of that column comes along as ``__total``.
    """
    groups = [ident(c) for c in by]
    value = ident(total) if total else F.lit(0)
    pieces = placed.groupBy(*groups, "__split").agg(
        F.min("__position").alias("__first"),
        F.count(F.lit(1)).alias("__rows"),
        F.sum(value).alias("__value"),
    )
    # These windows hold one row per split of the sort for each group, not its rows.
    group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = group.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(
        pieces.select(
            *groups,
            "__split",
            (F.col("__first") - F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - 1).alias("__zero"),
            F.sum("__value").over(group).alias("__total"),
        )
    )
    ranked = join_by(placed, offsets, [*by, "__split"]).withColumn(
        name, F.col("__position") - F.col("__zero")
    )
    return ranked.drop("__position", "__split", "__zero", *([] if total else ["__total"]))


def rank_within(
    df: DataFrame, *, by: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based rank of every row within its ``by`` group, no group held by one task.

    ``row_number()`` over a group puts all of it into one task. Here the whole table is
    range-sorted on (by, order), which cuts a large group over as many tasks as it needs,
    written with its positions, and shifted by the rows of the group in earlier splits.
    ``order`` must be total within a group for a repeatable rank. An action.
    """
    return _ranked(_placed(df, by, order), by, name)


def allocate(
    df: DataFrame, *, weight: str, total: int, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Split the integer ``total`` over each group's rows in proportion to ``weight``.

    Largest remainder: every row gets the whole part of its share, the leftover units go
    to the largest fractions, ties to the smallest ``key``. Weights are not negative; a
    group whose weights add up to zero gets null units. Whole-number weights are shared
    out in exact integer arithmetic. An action, see ``rank_within``.
    """
    exact = isinstance(df.schema[weight].dataType, _WHOLE_NUMBERS)
    kind = "decimal(19,0)" if exact else "double"
    groups = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    rows = rows.withColumn("__weight", ident(weight).cast(kind))
    sums = sized(
        rows.groupBy(*map(ident, groups)).agg(
            F.nullif(F.sum("__weight"), F.lit(0).cast(kind)).alias("__sum")
        )
    )
    scaled = F.col("__weight") * F.lit(total).cast(kind)
    if exact:
        whole = F.call_function("div", scaled, F.col("__sum"))
        fraction = scaled % F.col("__sum")
    else:
        whole = F.floor(scaled / F.col("__sum"))
        fraction = scaled / F.col("__sum") - F.col("__whole")
    shared = (
        join_by(rows, sums, groups)
        .withColumn("__whole", whole.cast("bigint"))
        .withColumn("__fraction", fraction)
        .drop("__weight", "__sum")
    )
    order = [F.col("__fraction").desc(), *[ident(c) for c in key]]
    ranked = _ranked(_placed(shared, groups, order), groups, "__rank", total="__whole")
    extra = (F.col("__rank") <= F.lit(total) - F.col("__total")).cast("bigint")
    return ranked.select(*[ident(c) for c in df.columns], (F.col("__whole") + extra).alias("units"))
