"""Tables to query: a folder of CSV or Parquet files, or a read-only relational source."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movecheck.functions.names import is_blocked, view_name
from movecheck.operators.policy import register
from movecheck.sources.csv_ranges import DIALECT, longest_file, read_split
from movecheck.sources.enforcement import check_sources, check_text


class ViewNameCollision(ValueError):
    """Two files of one folder would become the same view."""


def list_tables(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of a folder's tables, by name, from any file system Spark reads.

    A table is a file with this ending or a folder of part files with it. Names are
    listed and made distinct by Spark; contents are not read. A missing folder is empty.
    """
    inside = rf"(\Q{ending}\E)/[^/]*$"
    try:
        files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*{ending}")
        paths = files.select(F.regexp_replace("path", inside, "$1").alias("path")).distinct()
        return sorted(row.path for row in paths.collect())
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def view_names(paths: Iterable[str]) -> dict[str, str]:
    """View name to path. Names are checked against each other before anything is read."""
    views: dict[str, str] = {}
    for path in paths:
        file = PurePosixPath(path)
        name = view_name(file.stem)
        if name in views:
            other = PurePosixPath(views[name]).name
            raise ViewNameCollision(
                f"view name collision: {file.name} and {other} both become {name!r}"
            )
        views[name] = path
    return views


def register_folder(
    spark: SparkSession,
    folder: str,
    *,
    extras: Iterable[str] = (),
    schemas: Mapping[str, T.StructType] | None = None,
    format: str = "csv",
) -> dict[str, DataFrame]:
    """Make every table of a folder a view, blocked columns left out.

    A table is one file or a folder of part files, named ``<table>.<format>``. CSV files
    have a header, quotes inside quotes are doubled and quoted texts may hold line breaks;
    types are inferred unless ``schemas`` holds the view's schema, which saves a pass over
    the file. A table with a file longer than one range (``spark.sql.files.maxPartitionBytes``)
    is read by ranges (``csv_ranges``), with the same rows. Parquet brings its own schema and is
    read once. Returns the registered tables by view name, in file order.
    """
    extras, schemas = tuple(extras), schemas or {}
    one_range = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tables = {}
    for name, path in view_names(list_tables(spark, folder, f".{format}")).items():
        if format == "csv" and longest_file(spark, path) > one_range:
            df = read_split(spark, path, schemas.get(name))
        elif format == "csv":
            reader = spark.read.options(header=True, **DIALECT)
            given = schemas.get(name)
            reader = reader.schema(given) if given else reader.option("inferSchema", True)
            df = reader.csv(path)
        else:
            df = spark.read.format(format).load(path)
        tables[name] = register(df, name, extras)
    return tables


def run_query(
    spark: SparkSession, query: str | Callable[[SparkSession], DataFrame], extras: Sequence[str] = ()
) -> DataFrame:
    """A query over the registered views: SQL text or a function that builds a DataFrame.

    Text must be one query, and two parses see to it before anything runs, although
    ``spark.sql`` alone would carry out a write at once. By itself the text must be one
    statement, so its brackets, quotes and comments are closed and no second statement
    follows; then it must be the body of a WITH clause, where the grammar has no room for
    writes, DDL and commands. Neither parse alone is enough: the second would take text that
    closes the clause's bracket and goes on with a write.

    Text that calls by reflection, reads anything but registered views or uses a blocked
    name (the built-in ones and ``extras``) raises ``QueryRefused`` before anything runs. A
    function is the caller's own code and is trusted.
    """
    if callable(query):
        return query(spark)
    body = query.rstrip().removesuffix(";")
    check_text(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(body))
    analysed = spark.sql(f"WITH __query AS (\n{body}\n) SELECT * FROM __query")
    check_sources(analysed, extras)
    return analysed


def count_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact ``(table, n_rows)`` of all tables, empty ones included.

    Every table is counted without a key and without reading a column, and named afterwards.
    """
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.union, counted)


CATALOG = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)


def catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of every table (schemas only, no data read)."""
    rows = [
        (table, i, column, kind)
        for table, df in tables.items()
        for i, (column, kind) in enumerate(df.dtypes, start=1)
    ]
    return spark.createDataFrame(rows, CATALOG)


def table_profile(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    *,
    extras: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Every column of every table with type, row count of its table and blocked tag.

    Rows are counted unless ``counts`` brings ``(table, n_rows)``, such as a database's
    own estimates.
    """
    return (
        catalog(spark, tables)
        .join(count_rows(tables) if counts is None else counts, "table", "left")
        .withColumn("blocked", is_blocked(F.col("column"), extras))
    )


def jdbc_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options of a read-only relational source: no writes, 60 seconds per statement.

    With ``partition_column`` and ``bounds`` the table is read in ``partitions`` ranges;
    without them one connection reads everything.
    """
    options = {
        "url": url,
        "dbtable": table,
        "sessionInitStatement": "SET default_transaction_read_only = on",
        "queryTimeout": "60",
        "ApplicationName": "movecheck",
    }
    if partition_column and bounds:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def estimate_query(tables: Sequence[str]) -> str:
    """Subquery for ``jdbc_options`` that reads the planner's row estimates."""
    names = ", ".join("'" + t.replace("'", "''") + "'" for t in tables)
    return (
        "(SELECT relname AS table_name, CAST(reltuples AS bigint) AS estimate "
        f"FROM pg_class WHERE relname IN ({names})) AS estimates"
    )


def estimated_counts(estimates: DataFrame, tables: Sequence[str]) -> DataFrame:
    """``(table, n_rows)`` from planner estimates: 0 for an unknown table, null where a
    negative estimate says the table was never analysed."""
    wanted = estimates.sparkSession.createDataFrame([(t,) for t in tables], "table string")
    known = F.col("table_name").isNotNull()
    rows = F.when(~known, F.lit(0)).when(F.col("estimate") >= 0, F.col("estimate"))
    return wanted.join(estimates, F.col("table") == F.col("table_name"), "left").select(
        "table", rows.cast("bigint").alias("n_rows")
    )
