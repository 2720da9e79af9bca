"""Readers and writers of the records around a query."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movecheck.functions.names import pattern_key

# The records' fields and their order.
CHECK_SCHEMA = "struct<id:string,name:string,status:string,detail:string>"
REPORT_SCHEMA = (
    "version int, `case` string, sqlfile string, sql string, dialect string, "
    "executed_at string, row_count bigint, columns array<struct<name:string,dtype:string>>, "
    f"source_row_counts map<string,bigint>, checks array<{CHECK_SCHEMA}>, status string"
)
SCENARIO_SCHEMA = (
    "id string, `case` string, ground_truth string, matching_hypothesis string, "
    "distractors array<string>, data struct<kind:string,cmd:string,path:string>, "
    "expected_verdicts map<string,array<string>>"
)
TRACE_SCHEMA = (
    "id string, `case` string, created string, schema_summary string, intake string, "
    "hypothesis_slate string, "
    "hypotheses array<struct<id:string,sql:string,guard:string,verdict:string>>, "
    "ground_truth string, scores struct<found_true_cause:boolean,"
    "killed_the_false_prior:boolean,artifact_checked:boolean,honest_uncertainty:boolean>"
)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Extra policy patterns ``(pattern, key)``, one per line; blanks and ``#`` skipped.

    Patterns that could never match are refused when the policy is built from them;
    here a pattern of more than two tokens simply has no key a name could answer to.
    """
    line = F.trim("value")
    parts = F.filter(F.split(F.lower(line), r"\+"), lambda p: F.trim(p) != "")
    return (
        spark.read.text(path)
        .filter((line != "") & ~F.startswith(line, F.lit("#")))
        .select(
            line.alias("pattern"),
            F.array_join(F.transform(parts, lambda p: F.trim(p)), "+").alias("key"),
        )
    )


def load_patterns(spark: SparkSession, path: str) -> list[str]:
    """The pattern file as a list for ``is_blocked`` and ``register``, each one checked.

    A policy file is configuration of a few lines. A missing file is no extras.
    """
    try:
        patterns = [row.pattern for row in read_patterns(spark, path).collect()]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    for pattern in patterns:
        pattern_key(pattern)
    return patterns


def analysis_windows(config: DataFrame) -> DataFrame:
    """``(case, kind, start, end)`` from ``(case, kind, bounds array<string>)``.

    Only two-element bounds are windows; anything else is dropped, as if undeclared.
    """
    bounds = F.transform("bounds", lambda b: b.try_cast("date"))
    return (
        config.filter(F.size("bounds") == 2)
        .select("case", "kind", bounds[0].alias("start"), bounds[1].alias("end"))
        .filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    )


def focus_window(windows: DataFrame, case: str) -> tuple[date, date] | None:
    """The declared focus window of one case (reads that one row), None if undeclared."""
    rows = windows.filter((F.col("case") == case) & (F.col("kind") == "focus")).head(1)
    return (rows[0].start, rows[0].end) if rows else None


def _plain(path: Column) -> Column:
    """A ``_metadata`` path as the file system spells it: percent escapes undone, ``+`` kept."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _with_stem(df: DataFrame, ending: str) -> DataFrame:
    """Adds ``stem``: the name before ``ending`` of the file, or of the folder Spark wrote."""
    pattern = rf"([^/]+){ending}(?:/[^/]*)?$"
    return df.withColumn(
        "stem", F.regexp_extract(_plain(F.col("_metadata.file_path")), pattern, 1)
    )


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Audit reports with their ``stem``; a check without detail has an empty one.

    A report is a file ``<stem>.guard.json`` or belongs to a published version.
    """
    reports = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    filled = F.transform(
        "checks",
        lambda c: F.struct(
            c.id, c["name"], c.status, F.coalesce(c.detail, F.lit("")).alias("detail")
        ).cast(CHECK_SCHEMA),
    )
    return _with_stem(reports, r"(?:\.guard\.json|/run-[^/]+/report)").withColumn("checks", filled)


def write_report(report: DataFrame, path: str) -> None:
    """One report, replacing the last one of the same name (an action)."""
    report.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_result(result: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Write a result, replacing the last one (an action).

    CSV is UTF-8 with a header; quotes inside quotes are doubled, as other readers expect,
    and blanks at the ends of texts are kept.
    """
    writer = result.write.mode("overwrite")
    if format == "csv":
        writer = writer.options(header=True, encoding="UTF-8", quote='"', escape='"')
        writer = writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(format).save(path)


def read_result(spark: SparkSession, path: str, schema: T.StructType, *, format: str = "parquet") -> DataFrame:
    """A result as it was written by ``write_result``, with the given schema."""
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    return reader.format(format).load(path)


#: Versions of a name that stay, so that a reader that has just looked up the last but one can
#: still finish.
KEPT_VERSIONS = 2


class Published(NamedTuple):
    """The version of ``stem`` that counts; ``result`` is None if its query was refused or failed."""

    stem: str
    version: int
    report: str
    result: str | None


def run_folder(results: str, name: str) -> str:
    """A new folder for one run of ``name``; holds ``result`` and ``report``."""
    return f"{results.rstrip('/')}/{name}/run-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    files, place = _files(spark, path)
    return [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []


def _versions(spark: SparkSession, parent: str) -> list[tuple[int, str]]:
    """(version, run) of every pointer of a name, in order."""
    pairs = [name.partition("-") for name in _listed(spark, f"{parent}/versions")]
    return sorted((int(number), run) for number, _, run in pairs)


def publish(spark: SparkSession, folder: str) -> None:
    """Let the finished run in ``folder`` count from now on; readers switch in one step.

    The pointer is an empty file ``versions/<number>-<run>`` beside the run's folder. The largest
    name counts, so a new pointer replaces the last one by being created, which every file
    system does in one step, and nothing is overwritten. Two runs that publish at once get
    pointers of one number: one of them counts, whole. Versions before the last
    ``KEPT_VERSIONS`` are deleted afterwards; runs without a pointer are not touched.
    """
    parent, run = folder.rsplit("/", 1)
    last = _versions(spark, parent)
    number = last[-1][0] + 1 if last else 1
    files, pointer = _files(spark, f"{parent}/versions/{number:012d}-{run}")
    files.mkdirs(pointer.getParent())
    if not files.createNewFile(pointer):
        raise OSError(f"{pointer} exists already")
    for old, other in _versions(spark, parent)[:-KEPT_VERSIONS]:
        # The run first: while its pointer stands, an interrupted deletion is taken up again.
        for gone in (f"{parent}/{other}", f"{parent}/versions/{old:012d}-{other}"):
            files, place = _files(spark, gone)
            files.delete(place, True)


def published(spark: SparkSession, results: str, stems: Sequence[str] | None = None) -> list[Published]:
    """The version that counts of every name under ``results``, by name (lists names only).

    ``stems`` limits and orders the names; one that was never published is an error.
    """
    results = results.rstrip("/")
    last: dict[str, Published] = {}
    for stem in _listed(spark, results) if stems is None else stems:
        versions = _versions(spark, f"{results}/{stem}")
        if versions:
            number, run = versions[-1]
            folder = f"{results}/{stem}/{run}"
            there = "result" in _listed(spark, folder)
            last[stem] = Published(stem, number, f"{folder}/report", f"{folder}/result" if there else None)
    if stems is None:
        return [last[stem] for stem in sorted(last)]
    missing = [stem for stem in stems if stem not in last]
    if missing:
        raise FileNotFoundError(f"never published under {results}: {', '.join(missing)}")
    return [last[stem] for stem in stems]


def read_published_reports(spark: SparkSession, results: str) -> DataFrame:
    """The reports that count of all names under ``results``, with their ``stem``."""
    return read_reports(spark, [version.report for version in published(spark, results)])


def result_paths(spark: SparkSession, results: str, stems: Sequence[str]) -> list[str]:
    """Where the results that count lie; a name whose version has no result is an error."""
    versions = published(spark, results, stems)
    without = [version.stem for version in versions if version.result is None]
    if without:
        raise FileNotFoundError(f"published without a result: {', '.join(without)}")
    return [version.result for version in versions]


def read_results(spark: SparkSession, results: str, stems: Sequence[str]) -> DataFrame:
    """Rows of published Parquet results of one shape, with the ``stem`` each came from."""
    return _with_stem(spark.read.parquet(*result_paths(spark, results, stems)), "/run-[^/]+/result")


def read_documents(spark: SparkSession, path: str, *, ending: str = r"\.[^./]+") -> DataFrame:
    """One row per file: ``folder`` it lies in, ``stem``, ``file`` and the whole ``text``."""
    texts = spark.read.text(path, wholetext=True)
    parent = F.regexp_extract(_plain(F.col("_metadata.file_path")), r"([^/]*)/[^/]*$", 1)
    return _with_stem(texts, ending).select(
        parent.alias("folder"), "stem", _plain(F.col("_metadata.file_name")).alias("file"), F.col("value").alias("text")
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One row per SQL file: ``stem``, ``file`` and ``sql``."""
    documents = read_documents(spark, path, ending=r"\.sql")
    return documents.select("stem", "file", F.col("text").alias("sql"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records: the raw ``value`` of every non-blank line and its parsed ``trace``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.withColumn("trace", F.from_json("value", TRACE_SCHEMA))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario records, one JSON object per line."""
    return spark.read.schema(SCENARIO_SCHEMA).json(path)


def _result_name() -> Column:
    """The file's name, or the folder's for one of the part files Spark wrote a result in."""
    path = _plain(F.col("_metadata.file_path"))
    folder = F.regexp_extract(path, r"([^/]+?)(?:/run-[^/]+/result)?/part-\d{5}[^/]*$", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), F.element_at(F.split(path, "/"), F.lit(-1)))


def list_result_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` per result at ``path``, empty ones included (names only, no contents).

    A result is a file or a folder of part files and goes by its own name.
    """
    listing = spark.read.format("binaryFile").load(path)
    return listing.select(_result_name().alias("file")).distinct()


def read_result_rows(spark: SparkSession, path: str | list[str], *, format: str = "csv") -> DataFrame:
    """``file``, as in the listing, per data record of the results at ``path``.

    CSV records are counted as records: a quoted line break does not start a new one.
    """
    if format == "csv":
        reader = spark.read.schema("first string").options(header=True, quote='"', escape='"')
        rows = reader.option("multiLine", True).csv(path)
    else:
        rows = spark.read.format(format).load(path)
    return rows.select(_result_name().alias("file"))
