"""The tables behind a report: query index, result inventory, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movecheck.functions.columns import ident, join_by

PREVIEW_ROWS = 20  # Fixed value: rows shown of a table.
#: Up to so many rows of a group the planner cuts a ranking before the shuffle.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def query_index(queries: DataFrame, reports: DataFrame, *, results: str = "results") -> DataFrame:
    """Every query with its report's outcome; a query without one is ``missing``.

    ``queries`` has stem, file and sql; ``reports`` stem, status, row_count, sql and
    checks. The executed SQL is the report's, else the file's. Failed queries stay in.
    ``result`` is where a query's rows lie under ``results``, null if it left none.
    """
    failed = F.transform(
        F.filter("__checks", lambda c: c.status != "pass"), lambda c: F.coalesce(c["name"], c.id)
    )
    outcome = reports.select(
        "stem",
        F.col("status").alias("__status"),
        F.col("row_count"),
        F.nullif(F.col("sql"), F.lit("")).alias("__sql"),
        F.col("checks").alias("__checks"),
    )
    return (
        queries.join(outcome, "stem", "left")
        .select(
            "file",
            F.coalesce("__status", F.lit("missing")).alias("status"),
            F.coalesce("__sql", "sql").alias("sql"),
            "row_count",
            F.coalesce(failed, F.array().cast("array<string>")).alias("failed_checks"),
            F.when(
                F.col("row_count").isNotNull(), F.concat(F.lit(f"{results.rstrip('/')}/"), "stem")
            ).alias("result"),
        )
        .orderBy("file")
    )


def result_inventory(results: DataFrame, listing: DataFrame, *, file: str = "file") -> DataFrame:
    """Data rows per result. ``listing`` names all results, so empty ones count 0."""
    counts = results.groupBy(ident(file).alias("file")).agg(F.count(F.lit(1)).alias("__rows"))
    files = listing.select(ident(file).alias("file"))
    return files.join(counts, "file", "left").select(
        "file", F.coalesce("__rows", F.lit(0)).cast("bigint").alias("n_rows")
    )


def preview(
    df: DataFrame, *, order: Sequence[Column], by: Sequence[str] = (), limit: int = PREVIEW_ROWS
) -> DataFrame:
    """The first ``limit`` rows of each table, its total rows and a truncation mark.

    Either way only ``limit`` rows per table and input split ever move: a plain top-n
    without ``by``, a window the planner limits before the shuffle with it. The planner
    does that up to a limit of its own, which is raised in the session where ``limit`` is above.
    """
    if by:
        conf = df.sparkSession.conf
        if int(conf.get(GROUP_LIMIT)) < limit:
            conf.set(GROUP_LIMIT, str(limit))
        place = Window.partitionBy(*[ident(c) for c in by]).orderBy(*order)
        first = df.withColumn("position", F.row_number().over(place)).filter(
            F.col("position") <= limit
        )
        totals = df.groupBy(*[ident(c) for c in by]).agg(F.count(F.lit(1)).alias("total_rows"))
        shown = join_by(first, totals, by)
    else:
        total = df.agg(F.count(F.lit(1))).scalar()
        place = Window.partitionBy(F.lit(0)).orderBy(*order)
        shown = (
            df.orderBy(*order)
            .limit(limit)
            .withColumn("position", F.row_number().over(place))
            .withColumn("total_rows", total)
        )
    return shown.select(
        *[ident(c) for c in df.columns],
        "position",
        "total_rows",
        (F.col("total_rows") > limit).alias("truncated"),
    )
