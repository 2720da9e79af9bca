"""The personal-data policy applied to catalogs and, at the source, to tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movecheck.functions.columns import ident
from movecheck.functions.names import blocked_names, is_blocked, name_keys

#: Alias inside a view that marks it as registered; text cannot make a view, so it can't forge it.
MARK = "__registered_without_blocked_columns"


def protected(df: DataFrame, extras: Iterable[str] = ()) -> DataFrame:
    """``df`` without its blocked columns."""
    gone = set(blocked_names(df.columns, tuple(extras)))
    return df.select(*[ident(c) for c in df.columns if c not in gone])


def register(df: DataFrame, view: str, extras: Iterable[str] = ()) -> DataFrame:
    """Make ``df`` a temp view without its blocked columns.

    A query that names one anywhere then fails analysis and nothing runs; ``SELECT *``
    is safe. The view carries a mark, by which SQL text is held to registered views.
    """
    safe = protected(df, extras)
    safe.alias(MARK).createOrReplaceTempView(view)
    return safe


def flag_catalog(
    catalog: DataFrame, *, column: str = "column", patterns: DataFrame | None = None
) -> DataFrame:
    """Tag every catalog row with ``blocked``.

    ``patterns`` is a table of extra policy keys (see ``read_patterns``). Names meet
    them by equi-join on the keys a name answers to, so neither list is compared with
    the whole of the other. Extras add to the built-in policy, never replace it.
    """
    built_in = catalog.withColumn("blocked", is_blocked(ident(column)))
    if patterns is None:
        return built_in
    names = catalog.select(ident(column).alias("__name")).distinct()
    hits = (
        names.select("__name", F.explode(name_keys(F.col("__name"))).alias("key"))
        .join(patterns.select("key"), "key", "left_semi")
        .select("__name", F.lit(True).alias("__hit"))
        .distinct()
    )
    return (
        built_in.join(hits, ident(column) == F.col("__name"), "left")
        .withColumn("blocked", F.col("blocked") | F.coalesce("__hit", F.lit(False)))
        .drop("__name", "__hit")
    )


def blocked_subset(catalog: DataFrame, *, column: str = "column") -> DataFrame:
    """The blocked rows of a flagged catalog, in table and column order."""
    return catalog.filter("blocked").orderBy("table", "ordinal").select("table", "ordinal", column)


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Number of columns and of blocked columns per table."""
    return catalog.groupBy("table").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if("blocked").alias("n_blocked")
    )
