"""Registered queries: audits, column policy, verdict scoring, report and trace tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.functions.names import SINGLE_TOKENS, TOKEN_PAIRS, is_blocked
from movecheck.operators import audits, policy, reporting, scoring, traces
from movecheck.plans.registry import query, table
from movecheck.sources import tables as sources

FOCUS = ("1996-01-01", "1996-12-31")
ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --------------------------------------------------------------------- audits


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per month with a denominator, and the lowest price seen when it is low."""
    month = F.to_date(F.date_trunc("month", F.col("o_orderdate")))
    lowest = F.min("o_totalprice")
    return (
        table(spark, sf, "orders")
        .groupBy(month.alias("d"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.when(lowest < 1500, lowest).alias("lowest"),
        )
    )


_MONTHLY_SQL = """
    monthly AS (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, count(*) AS n,
             CASE WHEN min(o_totalprice) < 1500 THEN min(o_totalprice) END AS lowest
      FROM orders GROUP BY 1)
"""

# What each variant says its query was restricted to.
_RANGES = {
    "covered": ("1995-01-01", "2001-12-31"),
    "open end": ("1995-06-01", None),
    "late start": ("1996-02-01", "2001-12-31"),
    "early end": ("1995-01-01", "1996-06-30"),
    "unbounded": None,
    "complex": "complex",
}


@query(
    f"""
    WITH {_MONTHLY_SQL},
    early AS (SELECT * FROM monthly WHERE d < DATE '1996-06-01'),
    span AS (
      SELECT 'all' AS rows_kept, min(d) AS lo, max(d) AS hi FROM monthly
      UNION ALL SELECT 'early', min(d), max(d) FROM early),
    ranges(variant, kind, lo_bound, hi_bound) AS (VALUES
      ('covered', 'range', DATE '1995-01-01', DATE '2001-12-31'),
      ('open end', 'range', DATE '1995-06-01', NULL),
      ('late start', 'range', DATE '1996-02-01', DATE '2001-12-31'),
      ('early end', 'range', DATE '1995-01-01', DATE '1996-06-30'),
      ('unbounded', 'none', NULL, NULL), ('complex', 'complex', NULL, NULL)),
    judged AS (
      SELECT variant, rows_kept, kind,
             coalesce(lo_bound > DATE '1996-01-01', false) AS late,
             coalesce(hi_bound < DATE '1996-12-31', false) AS early,
             lo > DATE '1996-01-01' OR hi < DATE '1996-12-31' AS short, lo, hi, lo_bound, hi_bound
      FROM ranges CROSS JOIN span)
    SELECT variant, rows_kept, 'G-6' AS id,
      CASE kind WHEN 'none' THEN 'unbounded-window' WHEN 'complex' THEN 'window-undetermined'
                ELSE 'window-coverage' END AS name,
      CASE WHEN kind <> 'range' THEN 'warn' WHEN late OR early THEN 'error'
           WHEN short THEN 'warn' ELSE 'pass' END AS status,
      CASE WHEN kind = 'none' THEN 'dates are not restricted, so the focus window may be missed'
           WHEN kind = 'complex' THEN 'the restriction on dates could not be judged'
           WHEN late THEN 'only dates from ' || lo_bound || ' on, but the focus begins 1996-01-01'
           WHEN early THEN 'only dates up to ' || hi_bound || ', but the focus ends 1996-12-31'
           WHEN short THEN 'dates found: ' || lo || ' to ' || hi || '; focus: 1996-01-01 to 1996-12-31'
           ELSE '' END AS detail
    FROM judged
    """
)
def audit_window(spark: SparkSession, sf: str) -> DataFrame:
    """Q1, Q2: declared range and result span against the focus window."""
    monthly = _monthly(spark, sf)
    kept = {"all": monthly, "early": monthly.filter(F.col("d") < F.lit("1996-06-01").cast("date"))}
    # Each result is measured once; every declared range is judged on that one row.
    variants = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), audits.window_check(FOCUS, declared).alias("check"))
            for v, declared in _RANGES.items()
        ]
    )
    return union(
        [
            audits.measure(result)
            .select(F.inline(variants))
            .select("variant", F.lit(rows).alias("rows_kept"), "check.*")
            for rows, result in kept.items()
        ]
    )


def _one_check(check_id: str, audited: dict[str, DataFrame]) -> DataFrame:
    return union(
        [
            checks.filter(F.col("id") == check_id).select(F.lit(name).alias("result"), "*")
            for name, checks in audited.items()
        ]
    )


@query(
    """
    WITH sizes AS (
      SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS joined,
             (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders_n)
    SELECT 'customers only' AS result, 'G-7' AS id, 'join-fanout' AS name,
           CASE WHEN joined > 1.5 * customers THEN 'warn' ELSE 'pass' END AS status,
           CASE WHEN joined > 1.5 * customers
                THEN joined || ' rows are more than 1.5 times the largest source (' || customers || ')' ELSE '' END AS detail
    FROM sizes
    UNION ALL
    SELECT 'both sources', 'G-7', 'join-fanout',
           CASE WHEN joined > 1.5 * orders_n THEN 'warn' ELSE 'pass' END,
           CASE WHEN joined > 1.5 * orders_n
                THEN joined || ' rows are more than 1.5 times the largest source (' || orders_n || ')' ELSE '' END
    FROM sizes
    UNION ALL SELECT 'no sources', 'G-7', 'join-fanout', 'pass', 'sizes of the sources unknown'
    """
)
def audit_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: a per-customer result that a join multiplied, against its sources' sizes."""
    customer, orders = (table(spark, sf, n) for n in ("customer", "orders"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "c_mktsegment"
    )
    counts = sources.count_rows({"customer": customer, "orders": orders})
    # The join is measured once; each set of known sources is judged on that one row.
    known = {
        "customers only": counts.filter(F.col("table") == "customer"),
        "both sources": counts,
        "no sources": None,
    }
    judged = F.array(
        *[
            F.struct(F.lit(name).alias("result"), audits.fanout_check(audits.largest_source(some)).alias("check"))
            for name, some in known.items()
        ]
    )
    return audits.measure(joined).select(F.inline(judged)).select("result", "check.*")


def _sql_floor(result: str, source: str, column: str = "n") -> str:
    return f"""
      SELECT '{result}' AS result, 'G-8' AS id,
        CASE WHEN small > 0 THEN 'underpowered-risk' ELSE 'aggregate-floor' END AS name,
        CASE WHEN small > 0 THEN 'warn' ELSE 'pass' END AS status,
        CASE WHEN small > 0 THEN 'under 50 observations: {column} in ' || small || ' rows, lowest '
             || printf('%.1f', lowest) ELSE '' END AS detail
      FROM (SELECT count(*) FILTER (n < 50) AS small, (min(n) FILTER (n < 50))::DOUBLE AS lowest
            FROM ({source}))
    """


@query(
    _sql_floor("by customer", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
    + "UNION ALL"
    + _sql_floor("by priority", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
    + "UNION ALL"
    + _sql_floor("twice n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
    + """
    UNION ALL SELECT 'no denominator', 'G-8', 'no-denominator', 'warn',
                     'no column (n, n_*, *_n) says how many observations a row has'
    UNION ALL SELECT 'not an aggregate', 'G-8', 'aggregate-floor', 'pass', ''
    """
)
def audit_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Q4: denominators of aggregates by a fine and a coarse key."""
    orders = table(spark, sf, "orders")
    n = F.count(F.lit(1)).alias("n")
    by_customer = orders.groupBy("o_custkey").agg(n)
    by_priority = orders.groupBy("o_orderpriority").agg(n)
    rates = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("rate"))
    return _one_check(
        "G-8",
        {
            "by customer": audits.audit(by_customer, is_aggregate=True),
            "by priority": audits.audit(by_priority, is_aggregate=True),
            # Two columns of one name: the one that is too small must not hide behind the other.
            "twice n": audits.audit(
                by_customer.select("o_custkey", "n", F.lit(80).alias("n")), is_aggregate=True
            ),
            "no denominator": audits.audit(rates, is_aggregate=True),
            "not an aggregate": audits.audit(by_customer),
        },
    )


_LARGE_SQL = """
    large AS (
      SELECT c_custkey, c_mktsegment, biggest FROM customer LEFT JOIN (
        SELECT o_custkey, max(o_totalprice) AS biggest FROM orders
        WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey)
"""


def _largest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer with their biggest very large order, null for those without one."""
    biggest = (
        table(spark, sf, "orders")
        .filter(F.col("o_totalprice") > 400000)
        .groupBy("o_custkey")
        .agg(F.max("o_totalprice").alias("biggest"))
    )
    return (
        table(spark, sf, "customer")
        .select("c_custkey", "c_mktsegment")
        .join(biggest, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "c_mktsegment", "biggest")
    )


def _sql_nulls(result: str, source: str, column: str) -> str:
    return f"""
      SELECT '{result}' AS result, 'G-9' AS id, 'nulls' AS name,
             CASE WHEN share > 0.2 THEN 'warn' ELSE 'pass' END AS status,
             CASE WHEN share > 0.2 THEN 'missing in over 20%: {column}='
                  || round_even(share * 100, 0)::INT || '%' ELSE '' END AS detail
      FROM (SELECT count(*) FILTER ({column} IS NULL)::DOUBLE / nullif(count(*), 0) AS share FROM {source})
    """


@query(
    f"WITH {_LARGE_SQL}, {_MONTHLY_SQL}, complete AS (SELECT * FROM large WHERE biggest IS NOT NULL)"
    + _sql_nulls("outer join", "large", "biggest")
    + "UNION ALL"
    + _sql_nulls("complete", "complete", "biggest")
    + "UNION ALL"
    + _sql_nulls("monthly", "monthly", "lowest")
)
def audit_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: null shares of an outer join's result."""
    largest = _largest_orders(spark, sf)
    return _one_check(
        "G-9",
        {
            "outer join": audits.audit(largest),
            "complete": audits.audit(largest.filter(F.col("biggest").isNotNull())),
            "monthly": audits.audit(_monthly(spark, sf)),
        },
    )


@query(
    """
    WITH sizes AS (SELECT 'orders' AS result, count(*) AS n FROM orders
                   UNION ALL SELECT 'nation', count(*) FROM nation)
    SELECT result, 'G-12' AS id, CASE WHEN n > 5000 THEN 'not-an-aggregate?' ELSE 'size' END AS name,
           CASE WHEN n > 5000 THEN 'warn' ELSE 'pass' END AS status,
           CASE WHEN n > 5000 THEN n || ' rows, 5000 at most are expected' ELSE '' END AS detail
    FROM sizes
    """
)
def audit_size(spark: SparkSession, sf: str) -> DataFrame:
    """Q6: results too long to be aggregates."""
    return _one_check(
        "G-12", {n: audits.audit(table(spark, sf, n)) for n in ("orders", "nation")}
    )


def _audited(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Audit rows of three results, as their runs would report them."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    counts = sources.count_rows({"orders": orders, "customer": customer})
    coarse = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return {
        "h1_monthly": audits.audit_row(
            _monthly(spark, sf),
            focus=FOCUS,
            date_range=("1996-03-01", None),
            source_counts=counts,
            is_aggregate=True,
        ),
        "h2_priority": audits.audit_row(coarse, source_counts=counts, is_aggregate=True),
        "h3_largest": audits.audit_row(_largest_orders(spark, sf), source_counts=counts),
    }


_STATUS_SQL = f"""
    WITH {_MONTHLY_SQL}, {_LARGE_SQL},
    sources AS (SELECT greatest((SELECT count(*) FROM orders), (SELECT count(*) FROM customer)) AS biggest_n),
    checks(run, row_count, id, status) AS (
      SELECT 'h1_monthly', (SELECT count(*) FROM monthly), id, status FROM (VALUES
        ('G-5', 'pass'), ('G-6', 'error'), ('G-7', 'pass'),
        ('G-8', (SELECT CASE WHEN min(n) < 50 THEN 'warn' ELSE 'pass' END FROM monthly)),
        ('G-9', (SELECT CASE WHEN avg((lowest IS NULL)::INT) > 0.2 THEN 'warn' ELSE 'pass' END FROM monthly)),
        ('G-12', 'pass')) v(id, status)
      UNION ALL
      SELECT 'h2_priority', (SELECT count(DISTINCT o_orderpriority) FROM orders), id, status FROM (VALUES
        ('G-5', 'pass'), ('G-6', 'pass'), ('G-7', 'pass'),
        ('G-8', (SELECT CASE WHEN min(c) < 50 THEN 'warn' ELSE 'pass' END
                 FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority))),
        ('G-9', 'pass'), ('G-12', 'pass')) v(id, status)
      UNION ALL
      SELECT 'h3_largest', (SELECT count(*) FROM large), id, status FROM (VALUES
        ('G-5', 'pass'), ('G-6', 'pass'), ('G-7', 'pass'), ('G-8', 'pass'),
        ('G-9', (SELECT CASE WHEN avg((biggest IS NULL)::INT) > 0.2 THEN 'warn' ELSE 'pass' END FROM large)),
        ('G-12', (SELECT CASE WHEN count(*) > 5000 THEN 'warn' ELSE 'pass' END FROM large))) v(id, status))
"""


@query(
    _STATUS_SQL
    + """
    SELECT run, CASE max(CASE status WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END)
                WHEN 2 THEN 'error' WHEN 1 THEN 'warn' ELSE 'pass' END AS status
    FROM checks GROUP BY run
    """
)
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: worst status per run, from check rows."""
    checks = union(
        [
            row.select(F.lit(run).alias("run"), F.inline("checks"))
            for run, row in _audited(spark, sf).items()
        ]
    )
    return audits.rollup_status(checks, by=["run"])


@query(
    _STATUS_SQL
    + """,
    s AS (
      SELECT run AS stem, any_value(row_count) AS rows,
             (count(*) FILTER (status = 'pass'))::INT AS n_pass,
             (count(*) FILTER (status = 'warn'))::INT AS n_warn,
             (count(*) FILTER (status = 'error'))::INT AS n_error FROM checks GROUP BY run),
    l AS (SELECT *, CASE WHEN n_error > 0 THEN 'ERROR' WHEN n_warn > 0 THEN 'WARN' ELSE 'OK' END AS label FROM s)
    SELECT *, label || ' ' || stem || ': rows=' || rows || ' checks=' || n_pass || ' pass/'
           || n_warn || ' warn/' || n_error || ' error' AS line
    FROM l
    """
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Q9: one summary line per run."""
    reports = union(
        [row.withColumn("run", F.lit(run)) for run, row in _audited(spark, sf).items()]
    )
    return audits.run_summary(reports, stem="run")


def _order_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report per customer whose checks are those its orders' statuses stand for.

    Stands in for a large store of run reports, most of them incomplete.
    """
    per_customer = (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("o_orderstatus") == "F").alias("f"),
            F.count_if(F.col("o_orderstatus") == "O").alias("o"),
            F.count_if(F.col("o_orderstatus") == "P").alias("p"),
        )
    )

    def graded(check_id: str, name: str, amount: Column) -> Column:
        status = F.when(amount > 5, "error").when(amount > 3, "warn").otherwise("pass")
        return F.when(amount > 0, audits.check(check_id, name, status))

    checks = F.array_compact(
        F.array(
            graded("G-6", "window-coverage", F.col("f")),
            graded("G-8", "aggregate-floor", F.col("o")),
            graded("G-9", "nulls", F.col("p")),
        )
    )
    return per_customer.select("o_custkey", "row_count", checks.alias("checks")).withColumn(
        "status", audits.worst(F.col("checks"))
    )


_ORDER_REPORTS_SQL = """
    amounts AS (
      SELECT o_custkey, 'G-6' AS id, 'window-coverage' AS name, count(*) AS k, count(*) FILTER (o_orderstatus = 'F') AS a
      FROM orders GROUP BY 1
      UNION ALL
      SELECT o_custkey, 'G-8', 'aggregate-floor', count(*), count(*) FILTER (o_orderstatus = 'O') FROM orders GROUP BY 1
      UNION ALL
      SELECT o_custkey, 'G-9', 'nulls', count(*), count(*) FILTER (o_orderstatus = 'P') FROM orders GROUP BY 1),
    emitted AS (
      SELECT o_custkey, id, name, k,
             CASE WHEN a > 5 THEN 'error' WHEN a > 3 THEN 'warn' ELSE 'pass' END AS status, '' AS detail
      FROM amounts WHERE a > 0)
"""


@query(
    f"""
    WITH {_ORDER_REPORTS_SQL},
    expected(id, name) AS (VALUES ('G-5', 'redaction'), ('G-6', 'window-coverage'),
      ('G-7', 'join-fanout'), ('G-8', 'aggregate-floor'), ('G-9', 'nulls'), ('G-12', 'size')),
    missing AS (
      SELECT o_custkey, e.id, e.name, 'error' AS status, 'not evaluated' AS detail
      FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN expected e
      WHERE NOT EXISTS (SELECT 1 FROM emitted m WHERE m.o_custkey = c.o_custkey AND m.id = e.id))
    SELECT o_custkey, id, name, status, detail FROM emitted
    UNION ALL SELECT * FROM missing
    """
)
def complete_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: checks a report lacks, listed as errors."""
    completed = audits.complete_checks(_order_reports(spark, sf))
    return completed.select("o_custkey", F.inline("checks"))


# --------------------------------------------------------------- column policy

# Column-name endings hung on product words: some personal, some not.
_ENDINGS = ["email", "name", "first_name", "zip-code", "latency_ms", "ua", "mail", "longest",
            "User Agent", "count"]


def _product_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A column catalog spelled from the part table: brands as tables, products as columns."""
    endings = F.array(*[F.lit(e) for e in _ENDINGS])
    ending = F.element_at(endings, (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    words = F.replace("p_name", F.lit(" "), F.lit("_"))
    bare = F.col("p_size") == 1
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("table"),
        F.col("p_partkey").alias("ordinal"),
        F.when(bare, ending).otherwise(F.concat(words, F.lit("_"), ending)).alias("column"),
    )


_CATALOG_SQL = f"""
    catalog AS (
      SELECT p_brand AS "table", p_partkey AS ordinal,
        CASE WHEN p_size = 1 THEN e ELSE replace(p_name, ' ', '_') || '_' || e END AS "column"
      FROM (SELECT *, (['email', 'name', 'first_name', 'zip-code', 'latency_ms', 'ua', 'mail',
                        'longest', 'User Agent', 'count'])[p_partkey % 10 + 1] AS e FROM part)),
    tokens AS (
      SELECT *, list_filter(string_split_regex(lower("column"), '[^a-z0-9]+'), lambda t: t <> '') AS t
      FROM catalog),
    flagged AS (
      SELECT "table", ordinal, "column", t,
        list_has_any(t, {list(SINGLE_TOKENS)})
        OR list_has_any(list_transform(range(1, len(t)), lambda i: t[i] || '+' || t[i + 1]), {list(TOKEN_PAIRS)})
        OR t = ['name'] AS blocked
      FROM tokens)
"""


@query(f'WITH {_CATALOG_SQL} SELECT "table", ordinal, "column", blocked FROM flagged')
def column_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Is each catalog column blocked?"""
    return policy.flag_catalog(_product_catalog(spark, sf))


@query(f'WITH {_CATALOG_SQL} SELECT "table", ordinal, "column" FROM flagged WHERE blocked')
def blocked_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The blocked columns, in order."""
    return policy.blocked_subset(policy.flag_catalog(_product_catalog(spark, sf)))


@query(
    f"""
    WITH {_CATALOG_SQL},
    extra AS (
      SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_size = 2 AND NOT contains(p_name, ' ')
      UNION SELECT DISTINCT word || '+count'
      FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part WHERE p_size = 2))
    SELECT "table", ordinal, "column",
           blocked OR list_has_any(t || list_transform(range(1, len(t)), lambda i: t[i] || '+' || t[i + 1]),
                                   (SELECT list(key) FROM extra)) AS blocked
    FROM flagged
    """
)
def column_policy_with_extras(spark: SparkSession, sf: str) -> DataFrame:
    """Extra patterns taken from the data, met by equi-join."""
    part = table(spark, sf, "part").filter(F.col("p_size") == 2)
    words = part.filter(~F.contains("p_name", F.lit(" "))).select(F.lower("p_name").alias("key"))
    word = F.explode(F.split(F.lower("p_name"), " ")).alias("word")
    pairs = part.select(word).select(F.concat("word", F.lit("+count")).alias("key"))
    return policy.flag_catalog(
        _product_catalog(spark, sf), patterns=words.unionByName(pairs).distinct()
    )


@query(
    f"""
    WITH {_CATALOG_SQL}
    SELECT "table", count(*) AS n_columns, count(*) FILTER (blocked) AS n_blocked
    FROM flagged GROUP BY 1
    """
)
def column_policy_audit(spark: SparkSession, sf: str) -> DataFrame:
    """P5: blocked columns per table of the catalog."""
    return policy.catalog_summary(policy.flag_catalog(_product_catalog(spark, sf)))


def _renamed_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under column names of which two are personal."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("full_name"),
        F.concat("c_name", F.lit("@example.com")).alias("contact_email"),
        F.col("c_mktsegment").alias("plan_name"),
    )


@query("SELECT c_custkey AS user_id, c_mktsegment AS plan_name FROM customer")
def protected_view(spark: SparkSession, sf: str) -> DataFrame:
    """SELECT * over a registered view holds no blocked column."""
    policy.register(_renamed_customers(spark, sf), "protected_customers")
    return sources.run_query(spark, "SELECT * FROM protected_customers")


_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in ALL_TABLES
)


@query(_COUNTS_SQL)
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """S3: rows per table."""
    return sources.count_rows({t: table(spark, sf, t) for t in ALL_TABLES})


@query(
    f"WITH counts AS ({_COUNTS_SQL}), described AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", row_number() OVER () AS ordinal, column_name, column_type "
        f"FROM (DESCRIBE SELECT * FROM {t})"
        for t in ALL_TABLES
    )
    + """)
    SELECT "table", ordinal::INT AS ordinal, column_name AS "column",
           CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>'
                WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type,
           n_rows, false AS blocked
    FROM described JOIN counts USING ("table")
    """
)
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, types, row counts and blocked tags of all tables."""
    return sources.table_profile(spark, {t: table(spark, sf, t) for t in ALL_TABLES})


# -------------------------------------------------------------------- scoring

_HYPOTHESES = ["H1", "H2", "H3", "H4", "H-prior"]
_VERDICTS = ["KILLED", "SURVIVED", "UNDERPOWERED"]


def _verdict_columns() -> dict[str, Column]:
    """A verdict per hypothesis, spelled from a customer's numbers."""
    names = F.array(*[F.lit(v) for v in _VERDICTS])
    numbers = {
        "H1": F.col("c_custkey"),
        "H2": F.col("c_nationkey").cast("bigint"),
        "H3": F.col("c_custkey") + F.col("c_nationkey"),
        "H4": F.length("c_mktsegment").cast("bigint"),
        "H-prior": F.floor(F.abs("c_acctbal")),
    }
    return {h: F.element_at(names, (n % 3 + 1).cast("int")) for h, n in numbers.items()}


def _case_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One verdict document per customer: sound, short or spread shape, malformed, no block, other fences."""
    verdicts = _verdict_columns()
    kind = F.col("c_custkey") % 7
    lines = F.concat(
        *[
            F.concat(
                F.lit(f"  {h}: "),
                F.when(kind == 1, v)
                .when(kind == 6, F.concat(F.lit("\n    note: seen twice\n    verdict: "), v))
                .otherwise(F.concat(F.lit("{verdict: "), v, F.lit("}"))),
                F.lit("\n"),
            )
            for h, v in verdicts.items()
        ]
    )
    broken = F.when(kind == 2, "  H9: [unclosed\n").otherwise("")
    marker = F.when(kind == 3, "# other block\n").otherwise("# machine-verdicts v1\n")
    repeated = F.when(kind == 4, "  H2: {verdict: KILLED}\n").otherwise("")
    text = F.concat(
        F.lit("# Verdicts\n\nSee results.\n\n```\nplain block\n```\n\n"),
        F.when(kind == 5, "```sql\nSELECT 1\n```\n\n").otherwise(""),
        F.lit("```yaml\n"),
        marker, F.lit("case: "), F.col("c_custkey").cast("string"), F.lit("\nverdicts:\n"),
        lines, repeated, broken, F.lit("```\n"),
    )
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("case"), text.alias("text")
    )


_VERDICTS_SQL = """
    spelled AS (
      SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS "case",
        (['KILLED', 'SURVIVED', 'UNDERPOWERED'])[c_custkey % 3 + 1] AS h1,
        CASE WHEN c_custkey % 7 = 4 THEN 'KILLED'
             ELSE (['KILLED', 'SURVIVED', 'UNDERPOWERED'])[c_nationkey % 3 + 1] END AS h2,
        (['KILLED', 'SURVIVED', 'UNDERPOWERED'])[(c_custkey + c_nationkey) % 3 + 1] AS h3,
        (['KILLED', 'SURVIVED', 'UNDERPOWERED'])[length(c_mktsegment) % 3 + 1] AS h4,
        (['KILLED', 'SURVIVED', 'UNDERPOWERED'])[CAST(floor(abs(c_acctbal)) AS BIGINT) % 3 + 1] AS hp,
        c_custkey % 7 NOT IN (2, 3, 5) AS recorded
      FROM customer)
"""


@query(
    f"""
    WITH {_VERDICTS_SQL}
    SELECT "case", u.hypothesis, u.verdict FROM spelled,
      LATERAL (SELECT unnest(['H1', 'H2', 'H3', 'H4', 'H-prior']) AS hypothesis,
                      unnest([h1, h2, h3, h4, hp]) AS verdict) u
    WHERE recorded
    """
)
def verdict_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts read out of every document."""
    return scoring.extract_verdicts(_case_documents(spark, sf), key=["case"], text="text")


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """One scenario per customer, some without a prior among the distractors."""
    key = F.col("c_custkey")
    accepted = F.array(F.lit("KILLED"), F.lit("UNDERPOWERED"))
    expected = F.map_from_arrays(
        F.array(F.lit("H1"), F.lit("H3"), F.lit("H4")),
        F.array(F.array(F.lit("SURVIVED"), F.lit("KILLED")), accepted, accepted),
    )
    return table(spark, sf, "customer").select(
        F.format_string("%08d", key).alias("id"),
        key.cast("string").alias("case"),
        F.when(key % 5 == 0, scoring.MISSED).when(key % 5 == 1, "H2").otherwise("H1")
        .alias("matching_hypothesis"),
        F.when(key % 4 == 0, F.array(F.lit("H4"))).otherwise(F.array(F.lit("H-prior"), F.lit("H4")))
        .alias("distractors"),
        F.when(key % 6 != 0, expected).alias("expected_verdicts"),
    )


_SCORES_SQL = f"""
    WITH {_VERDICTS_SQL},
    marks AS (
      SELECT printf('%08d', c_custkey) AS id, "case",
        recorded AND CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN h2 = 'SURVIVED' ELSE h1 = 'SURVIVED' END
          AS found_true_cause,
        recorded AND (c_custkey % 4 = 0 OR hp = 'KILLED') AS killed_the_false_prior,
        recorded AND h1 IN ('KILLED', 'SURVIVED')
          AND (NOT list_contains([h2, h3, h4, hp], 'SURVIVED') OR h1 = 'KILLED') AS artifact_checked,
        recorded AND (c_custkey % 6 = 0 OR (h1 IN ('SURVIVED', 'KILLED')
          AND h3 IN ('KILLED', 'UNDERPOWERED') AND h4 IN ('KILLED', 'UNDERPOWERED'))) AS honest_uncertainty
      FROM spelled),
    scored AS (
      SELECT *, found_true_cause::INT + killed_the_false_prior::INT + artifact_checked::INT
             + honest_uncertainty::INT AS points FROM marks)
"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = scoring.verdict_maps(_case_documents(spark, sf), case="case", text="text")
    return scoring.score_scenarios(_scenarios(spark, sf), verdicts)


@query(_SCORES_SQL + "SELECT *, points || '/4' AS score FROM scored")
def scenario_score(spark: SparkSession, sf: str) -> DataFrame:
    """Four marks and the score of every scenario, by id."""
    return _scores(spark, sf).orderBy("id")


@query(
    _SCORES_SQL
    + """
    SELECT count(*) AS scenarios, count(*) FILTER (points = 4) AS full_marks,
           count(*) = count(*) FILTER (points = 4) AS passed FROM scored
    """
)
def scenario_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Do all scenarios have full marks?"""
    return scoring.score_gate(_scores(spark, sf))


# ------------------------------------------------------------------ reporting


@query(
    f"""
    WITH {_ORDER_REPORTS_SQL},
    reports AS (
      SELECT o_custkey, any_value(k) AS row_count,
             list(name ORDER BY length(id), id) FILTER (status <> 'pass') AS failed,
             CASE max(CASE status WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END)
               WHEN 2 THEN 'error' WHEN 1 THEN 'warn' ELSE 'pass' END AS status
      FROM emitted GROUP BY 1)
    SELECT 'h' || c_custkey || '.sql' AS file, coalesce(status, 'missing') AS status,
           CASE WHEN status IS NULL OR o_custkey % 2 = 0 THEN 'SELECT ' || c_custkey
                ELSE 'SELECT n -- ' || c_custkey END AS sql,
           row_count, coalesce(failed, []) AS failed_checks,
           CASE WHEN row_count IS NOT NULL THEN 'results/h' || c_custkey END AS result
    FROM customer LEFT JOIN reports ON o_custkey = c_custkey
    """
)
def query_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with its report; customers stand for queries, their orders for reports."""
    key = F.col("c_custkey").cast("string")
    queries = table(spark, sf, "customer").select(
        F.concat(F.lit("h"), key).alias("stem"),
        F.concat(F.lit("h"), key, F.lit(".sql")).alias("file"),
        F.concat(F.lit("SELECT "), key).alias("sql"),
    )
    run = F.col("o_custkey").cast("string")
    reports = _order_reports(spark, sf).select(
        F.concat(F.lit("h"), run).alias("stem"),
        "status",
        "row_count",
        # An empty statement in a report gives way to the file's.
        F.when(F.col("o_custkey") % 2 == 0, "")
        .otherwise(F.concat(F.lit("SELECT n -- "), run))
        .alias("sql"),
        "checks",
    )
    return reporting.query_index(queries, reports)


@query(
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, count(*) AS n_rows FROM {t}"
        for t in ("orders", "lineitem", "customer")
    )
)
def result_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """R2: data rows per result file."""
    results = [
        table(spark, sf, t).select(F.col("_metadata.file_name").alias("file"))
        for t in ("orders", "lineitem", "customer")
    ]
    listing = spark.createDataFrame(
        [(f"{t}.parquet",) for t in ("orders", "lineitem", "customer")], "file string"
    )
    return reporting.result_inventory(union(results), listing)


@query(
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, position::INT AS position,
           total_rows, total_rows > 20 AS truncated
    FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
                      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position,
                 count(*) OVER (PARTITION BY l_returnflag) AS total_rows FROM lineitem)
    WHERE position <= 20
    """
)
def result_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty line items of each return flag, with totals."""
    order = [F.col("l_extendedprice").desc()] + [
        F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ]
    shown = reporting.preview(
        table(spark, sf, "lineitem").select(
            "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        ),
        order=order,
        by=["l_returnflag"],
    )
    return shown.drop("l_suppkey")


# --------------------------------------------------------------------- traces


def trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON line per conversation turn, its whole text inside; some lines break the contract."""
    broken = F.col("conv_id") % 5
    turn = F.col("turn").cast("string")
    record = F.struct(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn).alias("id"),
        F.lit("0000").alias("case"),
        F.lit("2024-01-16").alias("created"),
        F.concat(F.lit("events rows: "), turn).alias("schema_summary"),
        F.col("text").alias("intake"),
        F.concat(F.lit("slate of "), F.col("role"), F.lit(" \"quoted\" \\ text")).alias("hypothesis_slate"),
        F.array(
            F.struct(
                F.lit("H1").alias("id"),
                F.when(broken == 1, "first_name").otherwise("SELECT n FROM events").alias("sql"),
                F.lit("pass").alias("guard"),
                F.lit("SURVIVED").alias("verdict"),
            )
        ).alias("hypotheses"),
        # A key missing, not null: to_json leaves null fields out.
        F.when(broken != 2, F.lit("renamed event")).alias("ground_truth"),
        F.struct(
            F.lit(True).alias("found_true_cause"), F.when(broken == 3, 1).alias("user_email")
        ).alias("scores"),
    )
    line = F.to_json(record)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(broken == 4, F.concat(F.lit("not json "), "text")).otherwise(line).alias("value")
    )


@query(
    """
    SELECT conv_id, turn, conv_id % 5 <> 4 AS parses,
           CASE conv_id % 5 WHEN 2 THEN ['ground_truth'] WHEN 4 THEN NULL ELSE [] END AS missing,
           CASE conv_id % 5 WHEN 1 THEN ['first_name'] WHEN 3 THEN ['user_email'] WHEN 4 THEN NULL ELSE [] END AS blocked,
           conv_id % 5 = 0 AS valid
    FROM conversations
    """
)
def trace_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Required keys and blocked names of every trace line."""
    checked = traces.trace_contract(trace_lines(spark, sf))
    return checked.select("conv_id", "turn", "parses", "missing", "blocked", "valid")


_NAMED_SQL = f"""
    SELECT conv_id, turn, list_distinct(list_filter(
      regexp_extract_all(lower(text), '[a-z0-9]+'),
      lambda t: list_contains({list(SINGLE_TOKENS)}, t))) AS found
    FROM conversations
"""


@query(
    f"""
    SELECT conv_id, turn, len(found) > 0 OR contains_pair OR bare AS blocked
    FROM ({_NAMED_SQL}) JOIN (
      SELECT conv_id, turn,
        regexp_matches(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'),
          '(^| )({"|".join(p.replace("+", " ") for p in TOKEN_PAIRS)})( |$)') AS contains_pair,
        trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) = 'name' AS bare
      FROM conversations) USING (conv_id, turn)
    """
)
def text_as_name(spark: SparkSession, sf: str) -> DataFrame:
    """P1 on whole texts: would the policy block a turn's text if it were a name?"""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", is_blocked(F.col("text")).alias("blocked")
    )
