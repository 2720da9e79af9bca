"""The three permitted tests: two proportions, difference in differences, power.

Each works on one row per contrast, so ``by`` answers all segments in one job. ``alpha``
is always explicit: a bad value fails at once. A bad *segment* does not stop the others;
it keeps its row with null statistics and ``valid`` false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movecheck.functions.columns import ident, ratio
from movecheck.functions.normal import check_alpha, critical_value, normal_cdf, two_sided_p


def arm_counts(
    df: DataFrame, *, outcome: Column, arm: Column, a: object, b: object, by: Sequence[str] = ()
) -> DataFrame:
    """Successes and sizes of arms ``a`` and ``b`` per group.

    Rows in neither arm are left out. A null outcome counts in the arm's size but not as
    a success. Call it on a fine key first and sum the counts up for a coarse one.
    """
    in_a, in_b = arm == F.lit(a), arm == F.lit(b)
    return df.groupBy(*[ident(c) for c in by]).agg(
        F.count_if(in_a & outcome).alias("a_success"),
        F.count_if(in_a).alias("a_n"),
        F.count_if(in_b & outcome).alias("b_success"),
        F.count_if(in_b).alias("b_n"),
    )


def two_prop_from_counts(
    counts: DataFrame, *, alpha: float, by: Sequence[str] = ()
) -> DataFrame:
    """Two-proportion z-test on columns a_success, a_n, b_success, b_n.

    z uses the pooled standard error, the interval the unpooled (Wald) one. Where the
    pooled rate is 0 or 1 the z statistic is undefined: null z and p-value.
    """
    z_crit = critical_value(alpha)
    a_s, a_n, b_s, b_n = (F.col(c) for c in ("a_success", "a_n", "b_success", "b_n"))
    valid = F.coalesce(
        (a_n > 0) & (b_n > 0) & a_s.between(F.lit(0), a_n) & b_s.between(F.lit(0), b_n),
        F.lit(False),
    )
    p_a, p_b = F.col("p_a"), F.col("p_b")
    pooled = F.col("__pooled")
    spread = F.sqrt(p_a * (1 - p_a) / F.col("__na") + p_b * (1 - p_b) / F.col("__nb"))
    pooled_error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("__na") + 1 / F.col("__nb")))
    return (
        counts.withColumn("valid", valid)
        # Sizes become null in an invalid row, and every statistic with them.
        .withColumn("__na", F.when(F.col("valid"), a_n.cast("double")))
        .withColumn("__nb", F.when(F.col("valid"), b_n.cast("double")))
        .withColumn("p_a", a_s / F.col("__na"))
        .withColumn("p_b", b_s / F.col("__nb"))
        .withColumn("__pooled", (a_s + b_s) / (F.col("__na") + F.col("__nb")))
        .withColumn("diff", p_a - p_b)
        .withColumn("z", ratio(F.col("diff"), pooled_error))
        .withColumn("__half", F.lit(z_crit) * spread)
        .select(
            *[ident(c) for c in by],
            F.lit("two-prop").alias("test"),
            "p_a",
            "p_b",
            "diff",
            "z",
            two_sided_p(F.col("z")).alias("p_value"),
            (F.col("diff") - F.col("__half")).alias("ci_low"),
            (F.col("diff") + F.col("__half")).alias("ci_high"),
            F.lit(alpha).alias("alpha"),
            "a_n",
            "b_n",
            "valid",
        )
    )


def two_prop(
    df: DataFrame,
    *,
    outcome: Column,
    arm: Column,
    a: object,
    b: object,
    alpha: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Two-proportion z-test from rows: a boolean ``outcome`` in arms ``a`` and ``b``."""
    check_alpha(alpha)
    counts = arm_counts(df, outcome=outcome, arm=arm, a=a, b=b, by=by)
    return two_prop_from_counts(counts, alpha=alpha, by=by)


def did(
    df: DataFrame,
    *,
    metric: str,
    group: str,
    period: str,
    alpha: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Difference in differences on daily aggregates, with HC1 standard errors.

    ``metric ~ group * period`` is saturated: its four coefficients are the four cell
    means, so the interaction and its robust error follow from the count, mean and
    variance of each cell: estimate = Σ ± mean, se² = N/(N−4) · Σ var/n. One aggregation,
    no solver. The p-value is normal, not t.

    ``group`` and ``period`` must be 0/1 in every row, and ``metric`` a number or null;
    otherwise the segment is invalid — recode in SQL. Rows with a null or NaN metric are in the cell counts but not in
    ``nobs`` or the estimate. An empty cell or N ≤ 4 gives null statistics.
    """
    check_alpha(alpha)
    g, p = (ident(c).try_cast("double") for c in (group, period))
    number = ident(metric).try_cast("double")
    y = F.when(~F.isnan(number), number)
    coded = F.coalesce(g.isin(0.0, 1.0) & p.isin(0.0, 1.0), F.lit(False)) & ~(
        ident(metric).isNotNull() & number.isNull()
    )
    cells = {
        "treat_post": (1.0, 1.0, 1),
        "control_pre": (0.0, 0.0, 1),
        "control_post": (0.0, 1.0, -1),
        "treat_pre": (1.0, 0.0, -1),
    }
    sums = [F.count_if(~coded).alias("__bad")]
    for name, (gv, pv, _) in cells.items():
        inside = (g == gv) & (p == pv)
        value = F.when(inside, y)
        sums += [
            F.count_if(inside).alias(f"n_{name}"),
            F.count(value).alias(f"__obs_{name}"),
            F.avg(value).alias(f"__mean_{name}"),
            F.var_pop(value).alias(f"__var_{name}"),
        ]
    cell = df.groupBy(*[ident(c) for c in by]).agg(*sums)
    nobs = sum((F.col(f"__obs_{n}") for n in cells), F.lit(0))
    usable = F.col("valid") & (F.col("nobs") > 4)
    estimate = sum((sign * F.col(f"__mean_{n}") for n, (_, _, sign) in cells.items()), F.lit(0.0))
    noise = sum(
        (ratio(F.col(f"__var_{n}"), F.col(f"__obs_{n}")) for n in cells), F.lit(0.0)
    )
    return (
        cell.withColumn("nobs", nobs)
        .withColumn("valid", (F.col("__bad") == 0) & (F.col("nobs") > 0))
        .withColumn("estimate", F.when(usable, estimate))
        .withColumn(
            "se",
            F.when(usable, F.sqrt(noise * ratio(F.col("nobs"), F.col("nobs") - 4))),
        )
        # Without an estimate (an empty cell) there is no error to report either.
        .withColumn("se", F.when(F.col("estimate").isNotNull(), F.col("se")))
        .withColumn("t", ratio(F.col("estimate"), F.col("se")))
        .select(
            *[ident(c) for c in by],
            F.lit("did").alias("test"),
            "estimate",
            "se",
            "t",
            two_sided_p(F.col("t")).alias("p_value"),
            F.lit(alpha).alias("alpha"),
            "nobs",
            *[f"n_{n}" for n in cells],
            "valid",
        )
    )


def power(
    contrasts: DataFrame,
    *,
    effect: Column,
    baseline: Column,
    n_a: Column,
    n_b: Column,
    alpha: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Achieved two-sided power for an absolute ``effect`` on a ``baseline`` rate.

    Cohen's h between baseline and baseline + effect against the normal critical value.
    A rate outside 0..1 or an empty arm gives null power and ``valid`` false.
    """
    z_crit = critical_value(alpha)
    rows = contrasts.select(
        *[ident(c) for c in by],
        effect.cast("double").alias("effect"),
        baseline.cast("double").alias("baseline"),
        n_a.cast("bigint").alias("n_a"),
        n_b.cast("bigint").alias("n_b"),
    )
    target = F.col("baseline") + F.col("effect")
    valid = F.coalesce(
        F.col("baseline").between(0.0, 1.0)
        & target.between(0.0, 1.0)
        & (F.col("n_a") > 0)
        & (F.col("n_b") > 0),
        F.lit(False),
    )
    h = 2 * F.asin(F.sqrt(F.col("baseline"))) - 2 * F.asin(F.sqrt(target))
    harmonic = F.col("n_a").cast("double") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    return (
        rows.withColumn("valid", valid)
        .withColumn("__shift", F.when(F.col("valid"), F.abs(h) * F.sqrt(harmonic)))
        .select(
            *[ident(c) for c in by],
            F.lit("power").alias("test"),
            (
                normal_cdf(F.col("__shift") - z_crit) + normal_cdf(-F.col("__shift") - z_crit)
            ).alias("power"),
            "effect",
            "baseline",
            "n_a",
            "n_b",
            F.lit(float(alpha)).alias("alpha"),
            "valid",
        )
    )
