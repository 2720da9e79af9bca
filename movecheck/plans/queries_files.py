"""Registered queries that go through the sinks and sources, on the given tables.

Files are written under the session's checkpoint folder, which every executor reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.operators import datasets, reporting, scoring
from movecheck.plans.audited_run import AuditError, audited_run
from movecheck.plans.queries_quality import trace_lines
from movecheck.plans.registry import query, table
from movecheck.session import scratch_folder
from movecheck.sources import csv_ranges, files
from movecheck.sources import tables as sources


@query(
    """
    SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_buyers,
           CAST(min(o_orderdate) AS DATE) AS first_day
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """
)
def csv_folder_views(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written as CSV, registered by folder, joined by SQL."""
    folder = scratch_folder(spark)
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    files.write_result(orders, f"{folder}/All Orders.csv", format="csv")
    files.write_result(customer, f"{folder}/customers-2024.csv", format="csv")
    sources.register_folder(spark, folder)
    return sources.run_query(
        spark,
        """
        SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_buyers,
               min(day) AS first_day
        FROM all_orders JOIN customers_2024 ON o_custkey = c_custkey GROUP BY c_mktsegment
        """,
    )


def _audited_runs(spark: SparkSession, sf: str) -> str:
    """Six audited runs over orders: fine, blocked, window missed, failing, a path, a reflective
    call. Returns their folder."""
    folder = scratch_folder(spark)
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").withColumnRenamed("c_name", "full_name")
    for name, df in {"orders": orders, "customers": customer}.items():
        sources.register(df, name)
    monthly = """
        SELECT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS d, count(*) AS n
        FROM orders GROUP BY 1
    """
    whole = ("1995-01-01", "2001-12-31")
    runs = {
        "h1_monthly": (monthly, whole),
        "h2_names": ("SELECT full_name, count(*) AS n FROM customers GROUP BY full_name", whole),
        "h3_window": (monthly, ("1996-06-01", "2001-12-31")),
        "h4_fails": ("SELECT CAST(o_orderstatus AS INT) AS n FROM orders", whole),
        "h5_path": (f"SELECT c_name AS label, count(*) AS n FROM parquet.`{sf}/customer.parquet` GROUP BY 1", whole),
        "h6_calls": ("SELECT reflect('java.lang.System', 'getenv') AS label, count(*) AS n FROM orders", whole),
    }
    for name, (text, declared) in runs.items():
        try:
            audited_run(
                spark,
                text,
                name=name,
                results=folder,
                case="orders",
                sources={"orders": orders},
                focus=("1996-01-01", "1996-12-31"),
                date_range=declared,
                is_aggregate=True,
            )
        except AuditError:
            pass  # the report says so
    return folder


_MONTHLY_SQL = """
    WITH monthly AS (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
"""


@query(
    _MONTHLY_SQL
    + """
    SELECT 'h1_monthly' AS stem, d, n FROM monthly UNION ALL SELECT 'h3_window', d, n FROM monthly
    """
)
def audited_results(spark: SparkSession, sf: str) -> DataFrame:
    """What the audited runs published; a missed window is published all the same."""
    folder = _audited_runs(spark, sf)
    return files.read_results(spark, folder, ["h1_monthly", "h3_window"])


@query(
    _MONTHLY_SQL
    + """
    SELECT 'h1_monthly' AS file, count(*) AS n_rows FROM monthly
    UNION ALL SELECT 'h3_window', count(*) FROM monthly
    """
)
def audited_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """R2: rows of each result the audited runs published, however many part files it has."""
    folder = _audited_runs(spark, sf)
    paths = files.result_paths(spark, folder, ["h1_monthly", "h3_window"])
    rows = files.read_result_rows(spark, paths, format="parquet")
    return reporting.result_inventory(rows, files.list_result_files(spark, paths))


@query(
    _MONTHLY_SQL
    + """,
    facts AS (
      SELECT (SELECT count(*) FROM monthly) AS months, (SELECT count(*) FROM orders) AS total,
             (SELECT CASE WHEN min(n) < 50 THEN 'warn' ELSE 'pass' END FROM monthly) AS floor_status)
    SELECT 'h1_monthly' AS stem, months AS row_count, total AS n_source, floor_status AS status,
           CASE floor_status WHEN 'warn' THEN ['G-8 underpowered-risk'] ELSE [] END AS failed FROM facts
    UNION ALL
    SELECT 'h2_names', NULL, NULL, 'error', ['G-5 redaction', 'G-6 window-coverage', 'G-7 join-fanout',
           'G-8 aggregate-floor', 'G-9 nulls', 'G-12 size']
    UNION ALL
    SELECT 'h3_window', months, total, 'error',
           CASE floor_status WHEN 'warn' THEN ['G-6 window-coverage', 'G-8 underpowered-risk']
                ELSE ['G-6 window-coverage'] END FROM facts
    UNION ALL
    SELECT 'h4_fails', NULL, NULL, 'error', ['G-6 window-coverage', 'G-7 join-fanout',
           'G-8 aggregate-floor', 'G-9 nulls', 'G-12 size']
    UNION ALL
    SELECT 'h5_path', NULL, NULL, 'error', ['G-5 redaction', 'G-6 window-coverage', 'G-7 join-fanout',
           'G-8 aggregate-floor', 'G-9 nulls', 'G-12 size']
    UNION ALL
    SELECT 'h6_calls', NULL, NULL, 'error', ['G-2 select-only', 'G-5 redaction', 'G-6 window-coverage',
           'G-7 join-fanout', 'G-8 aggregate-floor', 'G-9 nulls', 'G-12 size']
    """
)
def audited_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The reports the audited runs left, read back."""
    reports = files.read_published_reports(spark, _audited_runs(spark, sf))
    failed = F.filter("checks", lambda c: c.status != "pass")
    return reports.select(
        "stem",
        "row_count",
        F.try_element_at("source_row_counts", F.lit("orders")).alias("n_source"),
        "status",
        F.transform(failed, lambda c: F.concat(c.id, F.lit(" "), c["name"])).alias("failed"),
    )


@query(
    """
    WITH v AS (
      SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS owing FROM customer GROUP BY 1)
    SELECT 'nation=' || c_nationkey AS folder, u.hypothesis, u.verdict FROM v,
      LATERAL (SELECT unnest(['H1', 'H2']) AS hypothesis,
                      unnest([(['KILLED', 'SURVIVED', 'UNDERPOWERED'])[n % 3 + 1],
                              (['KILLED', 'SURVIVED', 'UNDERPOWERED'])[owing % 3 + 1]]) AS verdict) u
    """
)
def document_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """One document file per nation, read whole and searched for its verdicts."""
    names = F.array(*[F.lit(v) for v in ("KILLED", "SURVIVED", "UNDERPOWERED")])

    def verdict(n: str) -> Column:
        return F.element_at(names, (F.col(n) % 3 + 1).cast("int"))

    counts = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("owing"))
    )
    text = F.format_string(
        "# Verdicts\n\n```yaml\n# machine-verdicts v1\ncase: %s\nverdicts:\n  H1: {verdict: %s}\n  H2: %s\n```",
        F.col("c_nationkey"), verdict("n"), verdict("owing"),
    )
    folder = scratch_folder(spark)
    documents = counts.select(F.col("c_nationkey").alias("nation"), text.alias("value"))
    documents.write.partitionBy("nation").text(folder)
    read = files.read_documents(spark, f"{folder}/nation=*")
    return scoring.extract_verdicts(read, key=["folder"], text="text")


@query(
    """
    SELECT conv_id || '-' || turn AS id, 'H1' AS hypothesis, 'SURVIVED' AS verdict, length(text) AS n_chars
    FROM conversations WHERE conv_id % 5 <> 4
    """
)
def trace_records(spark: SparkSession, sf: str) -> DataFrame:
    """Trace lines written as text and read back as records."""
    folder = scratch_folder(spark)
    trace_lines(spark, sf).select("value").write.text(folder)
    records = files.read_traces(spark, folder).filter(F.col("trace.id").isNotNull())
    first = F.col("trace.hypotheses")[0]
    return records.select(
        F.col("trace.id").alias("id"),
        first["id"].alias("hypothesis"),
        first["verdict"].alias("verdict"),
        F.length("trace.intake").cast("bigint").alias("n_chars"),
    )


@query(
    """
    SELECT lower(p_name) AS pattern, replace(lower(p_name), ' ', '+') AS key, count(*) AS n
    FROM part WHERE p_partkey % 4 NOT IN (1, 2) GROUP BY 1, 2
    """
)
def pattern_file(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern file with comments, blanks and padding, read back."""
    folder = scratch_folder(spark)
    spaced = F.lower("p_name")
    kind = F.col("p_partkey") % 4
    line = (
        F.when(kind == 1, F.concat(F.lit("# "), spaced))
        .when(kind == 2, "   ")
        .otherwise(F.concat(F.lit("  "), F.replace(spaced, F.lit(" "), F.lit(" + ")), F.lit(" ")))
    )
    table(spark, sf, "part").select(line.alias("value")).write.text(folder)
    read = files.read_patterns(spark, folder)
    return read.groupBy(F.replace("key", F.lit("+"), F.lit(" ")).alias("pattern"), "key").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """
    SELECT CAST(o_custkey AS VARCHAR) AS "case", CASE WHEN o_orderkey % 2 = 0 THEN 'focus' ELSE 'baseline' END AS kind,
           CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 30 AS "end"
    FROM orders WHERE o_orderstatus = 'F'
    """
)
def declared_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows from configuration rows, malformed ones dropped."""
    day = F.to_date("o_orderdate")
    start, end = day.cast("string"), F.date_add(day, 30).cast("string")
    bounds = (
        F.when(F.col("o_orderstatus") == "F", F.array(start, end))
        .when(F.col("o_orderstatus") == "O", F.array(start))
        .otherwise(F.array(start, F.lit("soon")))
    )
    config = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("case"),
        F.when(F.col("o_orderkey") % 2 == 0, "focus").otherwise("baseline").alias("kind"),
        bounds.alias("bounds"),
    )
    return files.analysis_windows(config)


@query(
    """
    SELECT 'other layout' AS copy, count(*) AS n_rows, true AS same FROM lineitem
    UNION ALL SELECT 'one cent more', count(*), false FROM lineitem
    """
)
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A copy in other order and layout has the same fingerprint, a changed one hasn't."""
    items = table(spark, sf, "lineitem")
    first = items.agg(F.min("l_orderkey")).scalar()
    dearer = F.when(F.col("l_orderkey") == first, F.col("l_extendedprice") + 0.01).otherwise(F.col("l_extendedprice"))
    copies = {
        "other layout": items.select(*reversed(items.columns)).repartition(7, "l_partkey"),
        "one cent more": items.withColumn("l_extendedprice", dearer),
    }
    own = datasets.fingerprint(items).select(F.struct("n_rows", "content_hash")).scalar()
    judged = [
        datasets.fingerprint(copy).select(
            F.lit(name).alias("copy"), "n_rows", (F.struct("n_rows", "content_hash") == own).alias("same")
        )
        for name, copy in copies.items()
    ]
    return judged[0].unionByName(judged[1])


@query(
    """
    SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, lang, source FROM documents
    """
)
def csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks through a CSV file and its view."""
    folder = scratch_folder(spark)
    texts = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    quoted = texts.withColumn("quoted", F.concat(F.lit(' "a, b"\n'), "text", F.lit('\n"" ')))
    files.write_result(quoted, f"{folder}/texts.csv", format="csv")
    sources.register_folder(spark, folder)
    return sources.run_query(
        spark,
        """
        SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, lang, source
        FROM texts WHERE quoted = concat(' "a, b"\\n', text, '\\n"" ')
        """,
    )


@query(
    """
    SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, lang, source FROM documents
    """
)
def csv_ranges_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with quotes and line breaks in a CSV table, read by byte ranges."""
    folder = scratch_folder(spark)
    texts = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    files.write_result(texts, f"{folder}/texts.csv", format="csv")
    found = csv_ranges.read_split(spark, f"{folder}/texts.csv", texts.schema)
    return found.select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), "lang", "source"
    )
