"""Run a query, audit its result, publish both as one version by one fixed rule."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timezone

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.functions.names import blocked_names
from movecheck.operators.audits import (
    CHECK_TYPE,
    DateRange,
    audit_row,
    check,
    complete_checks,
    worst,
)
from movecheck.sources import files
from movecheck.sources.files import REPORT_SCHEMA
from movecheck.sources.enforcement import QueryRefused
from movecheck.sources.tables import count_rows, run_query

_REPORT_COLUMNS = re.findall(r"`?(\w+)`? (?:int|bigint|string|array|map)", REPORT_SCHEMA)


class AuditError(Exception):
    """A check of this run is an error; ``report`` is the written report's row."""

    def __init__(self, report) -> None:
        self.report = report
        failed = [c for c in report.checks if c.status == "error"]
        super().__init__("; ".join(f"{c.id} {c.name}: {c.detail}" for c in failed))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Classes of SQL state that blame the query or its data: unsupported, cardinality, data,
#: a user's function, syntax or access, raised by the query itself.
_QUERY_STATES = ("0A", "21", "22", "39", "42", "P0")


def _blames_query(spark: SparkSession, error: Exception) -> bool:
    """True if the query or its data is why it failed, not the cluster under it.

    A lost executor, a full disk or a missing file says nothing about the query; what was
    published before must stay then.
    """
    if isinstance(error, PythonException):
        return True
    cause = getattr(error, "_origin", None)
    while cause is not None:
        if is_instance_of(spark.sparkContext._gateway, cause, "org.apache.spark.SparkThrowable"):
            state = cause.getSqlState()
            if state and state.startswith(_QUERY_STATES):
                return True
        cause = cause.getCause()
    return False


def _unknown_blocked_name(error: AnalysisException, extras: Sequence[str]) -> list[str]:
    """Blocked names among the columns analysis could not resolve."""
    named = (error.getMessageParameters() or {}).get("objectName", "")
    return blocked_names(re.findall(r"`([^`]+)`", named), extras)


def audited_run(
    spark: SparkSession,
    query: str | Callable[[SparkSession], DataFrame],
    *,
    name: str,
    results: str,
    case: str = "",
    sources: Mapping[str, DataFrame] | None = None,
    focus: tuple[date | str, date | str] | None = None,
    date_range: DateRange | str | None = None,
    is_aggregate: bool = False,
    extras: Sequence[str] = (),
    format: str = "parquet",
):
    """Run, audit and publish result and report of ``name`` together, in one step.

    * A query that uses a blocked column, or text that is not one query, does not run:
      a report with a null ``row_count`` is published, and no result beside it.
    * A query that fails while running, for its own reasons, is published the same way.
    * Otherwise the result is published, also when a check on it is an error.

    In the first two cases the remaining checks are listed as errors naming the cause.
    Any error raises ``AuditError`` after the report is published; else the report's row
    is returned. Result and report are written to a folder of this run's own,
    ``results/<name>/run-<id>``, and the result is audited from those files: nothing is
    computed twice or held in executor memory. Then one empty file is made whose name says which
    run counts (see ``files.publish``). Whatever fails or is lost before that, an executor or
    this driver, the last pair stays as it was; runs of one name never mix their files.
    """
    extras = tuple(extras)
    folder = files.run_folder(results, name)
    counts = count_rows(sources) if sources else None

    def publish(audited: DataFrame, columns: DataFrame | None):
        types = [(c, kind) for c, kind in columns.dtypes] if columns is not None else []
        described = F.array(
            *[F.struct(F.lit(c).alias("name"), F.lit(k).alias("dtype")) for c, k in types]
        ).cast("array<struct<name:string,dtype:string>>")
        source_counts = F.create_map().cast("map<string,bigint>")
        if counts is not None and columns is not None:
            # One small entry per named source table.
            source_counts = counts.agg(
                F.map_from_entries(F.collect_list(F.struct("table", "n_rows")))
            ).scalar()
        values = {
            "version": F.lit(1),
            "case": F.lit(case),
            "sqlfile": F.lit(name),
            "sql": F.lit(query if isinstance(query, str) else getattr(query, "__name__", "")),
            "dialect": F.lit("spark"),
            "executed_at": F.lit(datetime.now(timezone.utc).isoformat()),
            "row_count": F.col("row_count"),
            "columns": described,
            "source_row_counts": source_counts,
            "checks": F.col("checks"),
            "status": F.col("status"),
        }
        files.write_report(
            audited.select(*[values[c].alias(c) for c in _REPORT_COLUMNS]), f"{folder}/report"
        )
        row = files.read_reports(spark, f"{folder}/report").first()
        files.publish(spark, folder)
        if row.status == "error":
            raise AuditError(row)
        return row

    def rejected(first: list, reason: str):
        checks = F.array(*first).cast(f"array<{CHECK_TYPE}>")
        empty = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"), checks.alias("checks"))
        publish(complete_checks(empty.withColumn("status", worst(F.col("checks"))), reason=reason), None)

    def audited():
        try:
            result = run_query(spark, query, extras)
            blocked = blocked_names(result.columns, extras)
        except QueryRefused as error:
            refused = check(error.check, error.name, "error", error.detail)
            return rejected([refused], f"not evaluated — {error.check} failed")
        except ParseException as error:
            detail = f"not a single query ({error.getCondition()})"
            return rejected([check("G-2", "select-only", "error", detail)], "not evaluated — G-2 failed")
        except AnalysisException as error:
            blocked = _unknown_blocked_name(error, extras)
            if not blocked:
                return rejected([], f"not evaluated — {error.getCondition() or 'query not analysed'}")
        if blocked:
            detail = "personal columns: " + ", ".join(blocked)
            return rejected([check("G-5", "redaction", "error", detail)], "not evaluated — G-5 failed")

        try:
            files.write_result(result, f"{folder}/result", format=format)
        except Exception as error:
            if not _blames_query(spark, error):
                raise
            _delete(spark, f"{folder}/result")
            return rejected(
                [check("G-5", "redaction", "pass")],
                f"not evaluated — {type(error).__name__} while running",
            )
        written = files.read_result(spark, f"{folder}/result", result.schema, format=format)
        row = audit_row(
            written,
            focus=focus,
            date_range=date_range,
            source_counts=counts,
            is_aggregate=is_aggregate,
            extras=extras,
        ).collect()
        # Six checks and a count, kept so that they are not computed again for the report.
        kept = spark.createDataFrame(row, f"row_count bigint, checks array<{CHECK_TYPE}>, status string")
        return publish(kept, result)

    try:
        return audited()
    except AuditError:
        raise
    except Exception:
        _delete(spark, folder)  # never published: nothing refers to it
        raise
