"""Registered queries: retention, contrasts and metric diagnostics on the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.functions.columns import round_report, ratio
from movecheck.functions.normal import two_sided_p
from movecheck.operators import contrasts, datasets, renames, retention, series
from movecheck.plans.registry import by_sql, query, rounded, table

ALPHA = 0.05
CUTOVER = date(2024, 1, 16)


def sql_two_sided_p(z: str) -> str:
    """Two-sided normal p-value in SQL, by Simpson's rule over 0..|z|.

    Independent of the rational approximation the Spark side uses.
    """
    weight = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = (
        f"list_sum(list_transform(range(0, 401), lambda i: ({weight}) * "
        f"exp(-0.5 * power(abs({z}) * i / 400.0, 2)))) * abs({z}) / 1200.0"
    )
    return f"(1 - 2 * ({area}) / sqrt(2 * pi()))"


# ------------------------------------------------------------------ retention


@query(
    """
    WITH users AS (SELECT user_id, min(CAST(ts AS DATE)) AS cohort FROM events GROUP BY 1),
    retained AS (
      SELECT DISTINCT u.user_id FROM users u JOIN events e ON e.user_id = u.user_id
      WHERE e.event_type = 'purchase'
        AND CAST(e.ts AS DATE) BETWEEN u.cohort + 7 AND u.cohort + 9)
    SELECT cohort, count(*) AS n, count(r.user_id) AS retained,
           round(count(r.user_id)::DOUBLE / count(*), 6) AS rate
    FROM users u LEFT JOIN retained r ON r.user_id = u.user_id GROUP BY cohort
    """
)
def cohort_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Purchase on days 7-9 after a user's first event, per cohort day."""
    events = table(spark, sf, "events")
    return rounded(
        retention.cohort_retention(
            retention.first_seen(events, user="user_id", ts="ts"),
            events,
            user="user_id",
            cohort="cohort",
            ts="ts",
            event="event_type",
            qualifying=["purchase"],
            first_day=7,
            last_day=9,
            by=["cohort"],
        )
    )


def _buyers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with an order: key, first order date, market segment."""
    first = retention.first_seen(table(spark, sf, "orders"), user="o_custkey", ts="o_orderdate")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return first.join(customer, F.col("o_custkey") == F.col("c_custkey"))


_BUYERS_SQL = """
    buyers AS (
      SELECT o_custkey, c_mktsegment, cohort FROM (
        SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS cohort FROM orders GROUP BY 1)
      JOIN customer ON c_custkey = o_custkey),
    retained AS (
      SELECT DISTINCT b.o_custkey AS k FROM buyers b JOIN orders o ON o.o_custkey = b.o_custkey
      WHERE CAST(o.o_orderdate AS DATE) BETWEEN b.cohort + 90 AND b.cohort + 180)
"""


def _repeat_orders(
    spark: SparkSession, sf: str, users: DataFrame, by: list[str], window: tuple[date, date] | None = None
) -> DataFrame:
    return retention.cohort_retention(
        users,
        table(spark, sf, "orders").select("o_custkey", "o_orderdate"),
        user="o_custkey",
        cohort="cohort",
        ts="o_orderdate",
        first_day=90,
        last_day=180,
        by=by,
        window=window,
    )


@query(
    f"""
    WITH {_BUYERS_SQL}
    SELECT c_mktsegment, count(*) AS n, count(k) AS retained,
           round(count(k)::DOUBLE / count(*), 6) AS rate
    FROM buyers LEFT JOIN retained ON k = o_custkey GROUP BY 1
    """
)
def order_repeat_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """D1 by segment: another order 90-180 days after the first."""
    return rounded(_repeat_orders(spark, sf, _buyers(spark, sf), ["c_mktsegment"]))


@query(
    f"""
    WITH {_BUYERS_SQL}
    SELECT c_mktsegment, count(*) AS n, count(k) AS retained,
           round(count(k)::DOUBLE / count(*), 6) AS rate
    FROM buyers LEFT JOIN retained ON k = o_custkey
    WHERE cohort BETWEEN DATE '1995-03-01' AND DATE '1995-05-31' GROUP BY 1
    """
)
def focus_window_retention(spark: SparkSession, sf: str) -> DataFrame:
    """D1 in a declared window: three months of cohorts; only orders that can count are read."""
    window = (date(1995, 3, 1), date(1995, 5, 31))
    return rounded(_repeat_orders(spark, sf, _buyers(spark, sf), ["c_mktsegment"], window))


_EARLY_LATE_SQL = f"""
    WITH {_BUYERS_SQL},
    complete AS (
      SELECT *, CASE WHEN cohort < DATE '1995-07-01' THEN 'early' ELSE 'late' END AS period
      FROM buyers WHERE cohort + 180 <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)),
    folded AS (
      SELECT c_mktsegment,
        count(*) FILTER (period = 'early') AS n_early,
        count(k) FILTER (period = 'early') AS retained_early,
        count(*) FILTER (period = 'late') AS n_late,
        count(k) FILTER (period = 'late') AS retained_late
      FROM complete LEFT JOIN retained ON k = o_custkey GROUP BY 1),
    rates AS (
      SELECT *, retained_early::DOUBLE / nullif(n_early, 0) AS re,
                retained_late::DOUBLE / nullif(n_late, 0) AS rl FROM folded)
"""


def _early_late(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    complete = retention.complete_cohorts(
        _buyers(spark, sf), cohort="cohort", last_day=180, events=orders, ts="o_orderdate"
    )
    early = F.col("cohort") < F.lit(date(1995, 7, 1))
    users = complete.withColumn("period", F.when(early, "early").otherwise("late"))
    rates = _repeat_orders(spark, sf, users, ["c_mktsegment", "period"])
    return retention.before_after(
        rates, period=F.col("period"), early="early", late="late", by=["c_mktsegment"]
    )


@query(
    _EARLY_LATE_SQL
    + """
    SELECT c_mktsegment, n_early, retained_early, n_late, retained_late,
           round(re, 6) AS rate_early, round(rl, 6) AS rate_late,
           round(rl - re, 6) AS change, round((re - rl) / nullif(re, 0), 6) AS relative_drop
    FROM rates
    """
)
def retention_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Complete cohorts only, early against late cohorts per segment."""
    return rounded(_early_late(spark, sf))


_COHORT_MONTHS_SQL = f"""
    WITH {_BUYERS_SQL},
    months AS (
      SELECT c_mktsegment, CAST(date_trunc('month', cohort) AS DATE) AS cohort_month,
             count(*) AS n, count(k) AS retained
      FROM buyers LEFT JOIN retained ON k = o_custkey GROUP BY 1, 2),
    judged AS (
      SELECT *, count(*) OVER w AS seen, retained::DOUBLE / n AS rate,
             (sum(retained) OVER w)::DOUBLE / sum(n) OVER w AS baseline
      FROM months
      WINDOW w AS (PARTITION BY c_mktsegment ORDER BY cohort_month
                   ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
    fallen AS (
      SELECT c_mktsegment, min(cohort_month) AS onset FROM judged
      WHERE seen = 2 AND (baseline - rate) / nullif(baseline, 0) >= 0.1 GROUP BY 1),
    onsets AS (
      SELECT s.c_mktsegment, s.cohorts, f.onset, round(j.rate, 6) AS onset_rate,
             round(j.baseline, 6) AS baseline_rate,
             round((j.baseline - j.rate) / j.baseline, 6) AS onset_drop
      FROM (SELECT c_mktsegment, count(*) AS cohorts FROM months GROUP BY 1) s
      LEFT JOIN fallen f USING (c_mktsegment)
      LEFT JOIN judged j ON j.c_mktsegment = f.c_mktsegment AND j.cohort_month = f.onset)
"""


def _onsets(spark: SparkSession, sf: str) -> DataFrame:
    users = _buyers(spark, sf).withColumn(
        "cohort_month", F.to_date(F.date_trunc("month", F.col("cohort")))
    )
    rates = _repeat_orders(spark, sf, users, ["c_mktsegment", "cohort_month"])
    return retention.cohort_onset(
        rates, cohort="cohort_month", trailing=2, drop=0.1, by=["c_mktsegment"]
    )


@query(_COHORT_MONTHS_SQL + "SELECT * FROM onsets")
def cohort_onset(spark: SparkSession, sf: str) -> DataFrame:
    """First monthly cohort at least 10 % below the two months before it."""
    return rounded(_onsets(spark, sf))


@query(
    _COHORT_MONTHS_SQL
    + """,
    changes AS (
      SELECT c_mktsegment, min(CAST(o_orderdate AS DATE)) AS changed_on
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY 1)
    SELECT onsets.*, changed_on,
           CASE WHEN changed_on IS NULL THEN 'no change' WHEN onset IS NULL THEN 'no onset'
                WHEN onset < changed_on THEN 'before change' ELSE 'after change' END AS timing
    FROM onsets LEFT JOIN changes USING (c_mktsegment)
    """
)
def onset_against_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Onset per segment against the day of the segment's first very large order."""
    large = (
        table(spark, sf, "orders")
        .filter(F.col("o_totalprice") > 300000)
        .groupBy("o_custkey")
        .agg(F.min(F.to_date("o_orderdate")).alias("first"))
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    changes = (
        large.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.min("first").alias("changed_on"))
    )
    return rounded(
        retention.onset_against_changes(
            _onsets(spark, sf), changes, changed_on="changed_on", on=["c_mktsegment"]
        )
    )


# ------------------------------------------------------------------ contrasts

_ARMS_SQL = """
    WITH counts AS (
      SELECT c_mktsegment,
        count(*) FILTER (o_orderdate < TIMESTAMP '1998-04-16' AND o_totalprice > 150000) AS sa,
        count(*) FILTER (o_orderdate < TIMESTAMP '1998-04-16') AS na,
        count(*) FILTER (o_orderdate >= TIMESTAMP '1998-04-16' AND o_totalprice > 150000) AS sb,
        count(*) FILTER (o_orderdate >= TIMESTAMP '1998-04-16') AS nb
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    p AS (
      SELECT *, sa::DOUBLE / na AS pa, sb::DOUBLE / nb AS pb,
             (sa + sb)::DOUBLE / (na + nb) AS pool FROM counts),
    t AS (
      SELECT *, (pa - pb) / nullif(sqrt(pool * (1 - pool) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)), 0) AS zz,
             1.959963984540054::DOUBLE * sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb) AS half FROM p)
"""


def _large_order_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Large orders before and after the middle of the period, per market segment.

    Counted per customer first: the join moves one row per customer, not per order.
    """
    later = F.col("o_orderdate") >= F.lit("1998-04-16").cast("timestamp_ntz")
    per_customer = contrasts.arm_counts(
        table(spark, sf, "orders"),
        outcome=F.col("o_totalprice") > 150000,
        arm=F.when(later, "after").otherwise("before"),
        a="before",
        b="after",
        by=["o_custkey"],
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(*[F.sum(c).alias(c) for c in ("a_success", "a_n", "b_success", "b_n")])
    )


@query(
    _ARMS_SQL
    + f"""
    SELECT c_mktsegment, 'two-prop' AS test, round(pa, 6) AS p_a, round(pb, 6) AS p_b,
           round(pa - pb, 6) AS diff, round(zz, 6) AS z, round({sql_two_sided_p('zz')}, 6) AS p_value,
           round(pa - pb - half, 6) AS ci_low, round(pa - pb + half, 6) AS ci_high,
           0.05::DOUBLE AS alpha, na AS a_n, nb AS b_n, true AS valid
    FROM t
    """
)
def two_prop_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """A1: share of large orders, first against second half of the period."""
    counts = _large_order_arms(spark, sf)
    return rounded(contrasts.two_prop_from_counts(counts, alpha=ALPHA, by=["c_mktsegment"]))


@query(
    _ARMS_SQL
    + """
    SELECT c_mktsegment, printf('%.6g', pa)::DOUBLE AS p_a, printf('%.6g', pb)::DOUBLE AS p_b,
           printf('%.6g', pa - pb)::DOUBLE AS diff, printf('%.6g', zz)::DOUBLE AS z, na AS a_n
    FROM t
    """
)
def six_digit_report(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the two-proportion table as reported, six significant digits."""
    tested = contrasts.two_prop_from_counts(
        _large_order_arms(spark, sf), alpha=ALPHA, by=["c_mktsegment"]
    )
    return round_report(tested.select("c_mktsegment", "p_a", "p_b", "diff", "z", "a_n"))


def _sql_did(daily: str, by: str = "") -> str:
    """HC1 difference in differences in SQL over ``daily(by.., g, p, y)``."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    WITH daily AS ({daily}),
    cells AS (
      SELECT {keys}
        count(*) FILTER (g = 1 AND p = 1) AS n11, count(*) FILTER (g = 0 AND p = 0) AS n00,
        count(*) FILTER (g = 0 AND p = 1) AS n01, count(*) FILTER (g = 1 AND p = 0) AS n10,
        avg(y) FILTER (g = 1 AND p = 1) AS m11, avg(y) FILTER (g = 0 AND p = 0) AS m00,
        avg(y) FILTER (g = 0 AND p = 1) AS m01, avg(y) FILTER (g = 1 AND p = 0) AS m10,
        var_pop(y) FILTER (g = 1 AND p = 1) AS v11, var_pop(y) FILTER (g = 0 AND p = 0) AS v00,
        var_pop(y) FILTER (g = 0 AND p = 1) AS v01, var_pop(y) FILTER (g = 1 AND p = 0) AS v10,
        count(*) AS total
      FROM daily {group}),
    fit AS (
      SELECT *, (m11 - m10) - (m01 - m00) AS est,
             sqrt((v11 / n11 + v00 / n00 + v01 / n01 + v10 / n10) * total / (total - 4)) AS err
      FROM cells)
    SELECT {keys}'did' AS test, round(est, 6) AS estimate, round(err, 6) AS se,
           round(est / err, 6) AS t, round({sql_two_sided_p('est / err')}, 6) AS p_value,
           0.05::DOUBLE AS alpha, total AS nobs, n11 AS n_treat_post, n00 AS n_control_pre,
           n01 AS n_control_post, n10 AS n_treat_pre, true AS valid
    FROM fit
    """


@query(
    _sql_did(
        """
        SELECT (event_type = 'purchase')::INT AS g,
               (CAST(ts AS DATE) >= DATE '2024-01-16')::INT AS p, count(*)::DOUBLE AS y
        FROM events WHERE event_type IN ('purchase', 'click')
        GROUP BY event_type, CAST(ts AS DATE)
        """
    )
)
def did_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3: daily purchases against clicks, before and after a date."""
    daily = (
        table(spark, sf, "events")
        .filter(F.col("event_type").isin("purchase", "click"))
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .withColumn("treated", (F.col("event_type") == "purchase").cast("int"))
        .withColumn("later", (F.col("day") >= F.lit(CUTOVER)).cast("int"))
    )
    return rounded(
        contrasts.did(daily, metric="n_events", group="treated", period="later", alpha=ALPHA)
    )


@query(
    _sql_did(
        """
        SELECT o_orderpriority, (o_orderstatus = 'F')::INT AS g,
               (CAST(o_orderdate AS DATE) >= DATE '1998-01-01')::INT AS p,
               sum(o_totalprice) AS y
        FROM orders GROUP BY o_orderpriority, o_orderstatus = 'F', CAST(o_orderdate AS DATE)
        """,
        by="o_orderpriority",
    )
)
def did_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """A2 by segment: daily revenue of finished orders against the rest, all priorities at once."""
    daily = (
        table(spark, sf, "orders")
        .groupBy(
            "o_orderpriority",
            (F.col("o_orderstatus") == "F").cast("int").alias("finished"),
            F.to_date("o_orderdate").alias("day"),
        )
        .agg(F.sum("o_totalprice").alias("revenue"))
        .withColumn("later", (F.col("day") >= F.lit(date(1998, 1, 1))).cast("int"))
    )
    return rounded(
        contrasts.did(
            daily,
            metric="revenue",
            group="finished",
            period="later",
            alpha=ALPHA,
            by=["o_orderpriority"],
        )
    )


@query(
    _ARMS_SQL
    + f""",
    s AS (
      SELECT *, abs(2 * asin(sqrt(pa)) - 2 * asin(sqrt(pa + 0.03))) / sqrt(1.0::DOUBLE / na + 1.0::DOUBLE / nb) AS shift
      FROM t),
    z AS (SELECT *, shift - 1.959963984540054 AS hi, -shift - 1.959963984540054 AS lo FROM s)
    SELECT c_mktsegment, 'power' AS test,
           round((CASE WHEN hi < 0 THEN {sql_two_sided_p('hi')} / 2
                       ELSE 1 - {sql_two_sided_p('hi')} / 2 END)
                 + {sql_two_sided_p('lo')} / 2, 6) AS power,
           0.03::DOUBLE AS effect, round(pa, 6) AS baseline, na AS n_a, nb AS n_b,
           0.05::DOUBLE AS alpha, true AS valid
    FROM z
    """
)
def power_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """A4: power to see three points more than each segment's own first-half share."""
    counts = _large_order_arms(spark, sf)
    return rounded(
        contrasts.power(
            counts,
            effect=F.lit(0.03),
            baseline=ratio(F.col("a_success"), F.col("a_n")),
            n_a=F.col("a_n"),
            n_b=F.col("b_n"),
            alpha=ALPHA,
            by=["c_mktsegment"],
        )
    )


@query(
    f"""
    SELECT c_custkey, round(z, 6) AS z, round({sql_two_sided_p('z')}, 6) AS p_value
    FROM (SELECT c_custkey, (c_acctbal - 4500) / 1500 AS z FROM customer)
    """
)
def normal_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided p-value of every customer's standardised balance."""
    z = (F.col("c_acctbal") - 4500) / 1500
    scored = table(spark, sf, "customer").select("c_custkey", z.alias("z"))
    return rounded(scored.withColumn("p_value", two_sided_p(F.col("z"))))


# ---------------------------------------------------------------- diagnostics


def _segmented_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_type", (F.col("user_id") % 3).alias("segment")
    )


def _renamed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a rename planted in one segment: the artefact the detection must find."""
    planted = [(0, "view", "view_v2", CUTOVER)]
    return renames.rename_events(
        _segmented_events(spark, sf), planted, segment=["segment"], event="event_type", ts="ts"
    )


_RENAMED_SQL = """
    renamed AS (
      SELECT user_id, ts, user_id % 3 AS segment, CAST(ts AS DATE) AS day,
             CASE WHEN event_type = 'view' AND user_id % 3 = 0
                   AND CAST(ts AS DATE) >= DATE '2024-01-16' THEN 'view_v2'
                  ELSE event_type END AS event_type
      FROM events)
"""


@query(
    f"""
    WITH {_RENAMED_SQL},
    w AS (
      SELECT segment, event_type AS event,
        count(*) FILTER (day < DATE '2024-01-16') AS before,
        count(*) FILTER (day >= DATE '2024-01-08' AND day < DATE '2024-01-16') AS pre,
        count(*) FILTER (day >= DATE '2024-01-16' AND day < DATE '2024-01-24') AS post,
        count(*) FILTER (day >= DATE '2024-01-16') AS after
      FROM renamed GROUP BY 1, 2),
    pairs AS (
      SELECT a.segment, a.event AS old_event, b.event AS new_event, a.pre AS old_volume,
             b.post AS new_volume, b.post::DOUBLE / a.pre AS r,
             count(*) OVER (PARTITION BY a.segment, a.event) AS candidates,
             row_number() OVER (PARTITION BY a.segment, a.event
                                ORDER BY abs(b.post - a.pre), b.event) AS place
      FROM w a JOIN w b ON a.segment = b.segment
      WHERE a.pre > 0 AND a.after = 0 AND b.before = 0 AND b.post > 0
        AND abs(b.post - a.pre) <= 0.25 * a.pre
        AND NOT EXISTS (SELECT 1 FROM w o WHERE o.event = b.event AND o.segment <> b.segment))
    SELECT segment, old_event, new_event, old_volume, new_volume,
           round(r, 6) AS volume_ratio, candidates
    FROM pairs WHERE place = 1
    """
)
def rename_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Finds the renamed event, its volume and its replacement."""
    return rounded(
        renames.detect_renames(
            _renamed_events(spark, sf),
            segment=["segment"],
            event="event_type",
            ts="ts",
            cutover=CUTOVER,
        )
    )


@query(
    """
    SELECT user_id % 3 AS segment, event_type, CAST(ts AS DATE) AS day, count(*) AS n
    FROM events GROUP BY 1, 2, 3
    """
)
def canonical_daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Detected renames undone; the daily counts are those before the rename."""
    segment = ["segment"]
    events = _renamed_events(spark, sf)
    found = renames.detect_renames(
        events, segment=segment, event="event_type", ts="ts", cutover=CUTOVER
    )
    mapping = renames.canonical_mapping(found, segment=segment, cutover=CUTOVER)
    # Counts carry everything the mapping needs, so only daily counts meet it.
    daily = events.groupBy("segment", "event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    restored = renames.rename_events(
        daily, mapping, segment=segment, event="event_type", ts="day"
    )
    return restored.groupBy("segment", "event_type", "day").agg(F.sum("n").alias("n"))


def _view_retention(events: DataFrame) -> DataFrame:
    return retention.cohort_retention(
        retention.first_seen(events, user="user_id", ts="ts").withColumn(
            "segment", F.col("user_id") % 3
        ),
        events,
        user="user_id",
        cohort="cohort",
        ts="ts",
        event="event_type",
        qualifying=["view"],
        first_day=17,
        last_day=20,
        by=["segment"],
    )


@query(
    f"""
    WITH {_RENAMED_SQL},
    users AS (SELECT user_id, min(CAST(ts AS DATE)) AS cohort FROM events GROUP BY 1),
    seen AS (
      SELECT u.user_id, u.user_id % 3 AS segment,
             bool_or(e.event_type = 'view') AS canonical, bool_or(r.event_type = 'view') AS raw
      FROM users u
      LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'view'
        AND CAST(e.ts AS DATE) BETWEEN u.cohort + 17 AND u.cohort + 20
      LEFT JOIN renamed r ON r.user_id = u.user_id AND r.event_type = 'view'
        AND r.day BETWEEN u.cohort + 17 AND u.cohort + 20
      GROUP BY 1, 2)
    SELECT segment, count(*) AS n, count(*) FILTER (raw) AS retained_raw,
           count(*) FILTER (canonical) AS retained_canonical
    FROM seen GROUP BY 1
    """
)
def rename_effect_on_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Retention as logged and on canonical names, side by side per segment."""
    raw = _renamed_events(spark, sf)
    undo = spark.createDataFrame(
        [(0, "view_v2", "view", CUTOVER)], "segment bigint, name string, renamed_to string, from_date date"
    )
    fixed = renames.rename_events(raw, undo, segment=["segment"], event="event_type", ts="ts")
    left = _view_retention(raw).select("segment", "n", F.col("retained").alias("retained_raw"))
    right = _view_retention(fixed).select(
        F.col("segment").alias("s"), F.col("retained").alias("retained_canonical")
    )
    return left.join(right, F.col("segment") == F.col("s")).drop("s")


@query(
    f"""
    WITH {_RENAMED_SQL},
    w AS (
      SELECT segment,
        count(*) FILTER (day >= DATE '2024-01-08' AND day < DATE '2024-01-16') AS pre,
        count(*) FILTER (day >= DATE '2024-01-16' AND day < DATE '2024-01-24') AS post
      FROM renamed GROUP BY 1)
    SELECT segment, round(pre / 8.0::DOUBLE, 6) AS pre_daily, round(post / 8.0::DOUBLE, 6) AS post_daily,
           round(post::DOUBLE / pre, 6) AS volume_ratio,
           abs(post::DOUBLE / pre - 1) <= 0.1 AS conserved
    FROM w
    """
)
def volume_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Total events per day stay flat through the rename."""
    return rounded(
        renames.volume_conservation(
            _renamed_events(spark, sf),
            segment=["segment"],
            ts="ts",
            cutover=CUTOVER,
            days=8,
            tolerance=0.1,
        )
    )


@query(
    """
    WITH c AS (
      SELECT o_orderpriority,
        count(*) FILTER (year(o_orderdate) = 1998) AS n_focus,
        count(*) FILTER (year(o_orderdate) = 1997) AS n_baseline
      FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY 1),
    s AS (
      SELECT *, n_focus::DOUBLE / (SELECT sum(n_focus) FROM c) AS f,
                n_baseline::DOUBLE / (SELECT sum(n_baseline) FROM c) AS b FROM c)
    SELECT o_orderpriority, n_focus, n_baseline, round(f, 6) AS focus_share,
           round(b, 6) AS baseline_share, round(f - b, 6) AS share_shift
    FROM s
    """
)
def mix_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Order mix by priority, one year against the year before."""
    day = F.to_date("o_orderdate")
    return rounded(
        series.mix_shift(
            table(spark, sf, "orders"),
            category="o_orderpriority",
            focus=day.between(F.lit(date(1998, 1, 1)), F.lit(date(1998, 12, 31))),
            baseline=day.between(F.lit(date(1997, 1, 1)), F.lit(date(1997, 12, 31))),
        )
    )


@query(
    """
    SELECT c_nationkey, c_mktsegment, count(*) AS n,
           round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share
    FROM customer GROUP BY 1, 2
    """
)
def mix_share_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Market-segment mix inside each nation."""
    return rounded(
        series.mix_share(table(spark, sf, "customer"), category="c_mktsegment", by=["c_nationkey"])
    )


def _daily_value(spark: SparkSession, sf: str) -> DataFrame:
    return series.daily_totals(
        table(spark, sf, "events"), ts="ts", value=F.col("value"), by=["event_type"]
    )


@query(
    """
    WITH daily AS (
      SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2),
    m AS (
      SELECT event_type,
        avg(total) FILTER (day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS d,
        avg(total) FILTER (day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09') AS b,
        avg(total) FILTER (day BETWEEN DATE '2024-01-13' AND DATE '2024-01-19') AS a
      FROM daily GROUP BY 1)
    SELECT event_type, round(d, 6) AS dip_mean, round(b, 6) AS mean_before,
           round(a, 6) AS mean_after, round(d / ((b + a) / 2), 6) AS dip_ratio
    FROM m
    """
)
def dip_vs_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Three days against the weeks on both sides, per event type."""
    return rounded(
        series.dip_against_neighbours(
            _daily_value(spark, sf), start=date(2024, 1, 10), end=date(2024, 1, 12), by=["event_type"]
        )
    )


@query(
    """
    WITH daily AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1)
    SELECT day, round(total, 6) AS total,
           round(total / (SELECT median(total) FROM daily), 6) AS day_index FROM daily
    """
)
def median_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every day's value against the median day."""
    daily = series.daily_totals(table(spark, sf, "events"), ts="ts", value=F.col("value"))
    return rounded(series.index_to_median(daily))


@query(
    """
    WITH daily AS (
      SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2)
    SELECT event_type, day, round(total, 6) AS total,
           round(total / median(total) OVER (PARTITION BY event_type), 6) AS day_index FROM daily
    """
)
def median_index_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """D9 per event type."""
    return rounded(series.index_to_median(_daily_value(spark, sf), by=["event_type"]))


# ----------------------------------------------------------------- datasets


@query(
    """
    SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
           CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
           count(*) = count(DISTINCT o_orderkey) AS is_key
    FROM orders
    """
)
def key_range_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Is the order key a key, and which days are covered?"""
    return datasets.key_audit(table(spark, sf, "orders"), key=["o_orderkey"], ts="o_orderdate")


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1
    """
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Line items that share order and line number."""
    return datasets.duplicate_keys(table(spark, sf, "lineitem"), key=["l_orderkey", "l_linenumber"])


def _two_exports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The events table, and an export of it that merged two event types."""
    events = table(spark, sf, "events")
    merged = F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type"))
    return events, events.withColumn("event_type", merged)


_DIFF_SQL = """
    WITH both_exports AS (
      SELECT *, 1 AS l, 0 AS r FROM events
      UNION ALL
      SELECT * REPLACE (CASE event_type WHEN 'error' THEN 'click' ELSE event_type END AS event_type), 0, 1 FROM events),
    d AS (
      SELECT * EXCLUDE (l, r), sum(l)::BIGINT AS left_n, sum(r)::BIGINT AS right_n
      FROM both_exports GROUP BY ALL HAVING sum(l) <> sum(r))
"""


@query(_DIFF_SQL + "SELECT * FROM d")
def dataset_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose number of copies differs between two exports."""
    return datasets.dataset_diff(*_two_exports(spark, sf))


@query(
    _DIFF_SQL
    + """
    SELECT coalesce(sum(greatest(left_n - right_n, 0)), 0)::BIGINT AS only_left,
           coalesce(sum(greatest(right_n - left_n, 0)), 0)::BIGINT AS only_right,
           count(*) = 0 AS identical
    FROM d
    """
)
def dataset_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Are the two exports the same multiset?"""
    return datasets.dataset_equality(*_two_exports(spark, sf))


@query(
    """
    WITH w AS (
      SELECT c_nationkey, c_custkey, count(o_orderkey) AS weight
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    s AS (
      SELECT *, (weight * 1000) // sum(weight) OVER g AS whole, (weight * 1000) % sum(weight) OVER g AS rest
      FROM w WINDOW g AS (PARTITION BY c_nationkey)),
    k AS (
      SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, c_custkey) AS place,
             1000 - sum(whole) OVER (PARTITION BY c_nationkey) AS leftover FROM s)
    SELECT c_nationkey, c_custkey, weight,
           CAST(whole + (place <= leftover)::INT AS BIGINT) AS units FROM k
    """
)
def allocate_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand units per nation over its customers, by their number of orders."""
    counts = (
        table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("weight"))
    )
    weights = (
        table(spark, sf, "customer")
        .select("c_nationkey", "c_custkey")
        .join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_nationkey", "c_custkey", F.coalesce("weight", F.lit(0)).alias("weight"))
    )
    return datasets.allocate(
        weights, weight="weight", total=1000, key=["c_custkey"], by=["c_nationkey"]
    )


@query(
    """
    SELECT user_id, ts, event_type AS event_name FROM events
    UNION ALL
    SELECT o_custkey, o_orderdate, 'order_' || o_orderstatus FROM orders
    ORDER BY ts, user_id
    """
)
def event_union(spark: SparkSession, sf: str) -> DataFrame:
    """Events and orders as one stream, sorted by time and user."""
    events = table(spark, sf, "events").select(
        "user_id", "ts", F.col("event_type").alias("event_name")
    )
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("order_"), "o_orderstatus").alias("event_name"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("user_id"),
    )
    return renames.union_streams([events, orders], order=["ts", "user_id"])


# ---------------------------------------------------------- plain SQL on views


@query(
    """
    SELECT event_type, count(*) AS n FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY event_type
    """
)
def sql_counts(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate over a registered view; the upper bound is midnight, as written."""
    return by_sql(
        spark,
        sf,
        """
        SELECT event_type, count(*) AS n FROM events
        WHERE ts BETWEEN TIMESTAMP_NTZ '2024-01-05' AND TIMESTAMP_NTZ '2024-01-20'
        GROUP BY event_type
        """,
        ["events"],
    )


_SET_SQL = """
    WITH active AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < {ts} '1996-01-01'),
         late AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= {ts} '2001-01-01')
    SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM active INTERSECT SELECT * FROM late)
    UNION ALL
    SELECT 'lost', count(*) FROM (SELECT * FROM active EXCEPT SELECT * FROM late)
    UNION ALL
    SELECT 'any', count(*) FROM (SELECT * FROM active UNION SELECT * FROM late)
"""


@query(_SET_SQL.format(ts="TIMESTAMP"))
def sql_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Set operations over SELECTs."""
    return by_sql(spark, sf, _SET_SQL.format(ts="TIMESTAMP_NTZ"), ["orders"])
