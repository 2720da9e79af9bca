"""Normal tail, rounding and name policy against hand-made values."""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from movecheck.functions.columns import ratio, round_report, six_digits
from movecheck.functions.names import (
    SINGLE_TOKENS,
    TOKEN_PAIRS,
    blocked_names,
    is_blocked,
    is_date_name,
    is_denominator_name,
    name_keys,
    pattern_key,
    policy_keys,
    view_name,
)
from movecheck.functions.normal import critical_value, erfc, normal_cdf, two_sided_p

BLOCKED = """email user_email Email email_count first_name last_name full_name display_name surname
name phone phone_number mobile msisdn shipping_address street zip zip_code zipcode postal_code ip
ip_address client_ip user_agent useragent ua ssn social_security national_id tax_id dob birth_date
date_of_birth birthday lat latitude lng lon longitude long geo_lat""".split()
ALLOWED = """event_name plan_name flag_name campaign_name company_name table_name user_id latency_ms
longest_streak mailing_list_id signup_date platform country mrr spend streak agent_version
userEmail""".split()


def test_erfc_is_accurate_over_all_three_branches(spark):
    points = spark.range(-900, 901).select((F.col("id") / 70.0).alias("x"))
    for row in points.select("x", erfc(F.col("x")).alias("e")).collect():
        assert row.e == pytest.approx(math.erfc(row.x), rel=1e-12)


def test_normal_functions(spark):
    row = (
        spark.range(1)
        .select(
            two_sided_p(F.lit(-7.5)).alias("p"),
            normal_cdf(F.lit(-1.0)).alias("low"),
            normal_cdf(F.lit(1.0)).alias("high"),
            two_sided_p(F.lit(None).cast("double")).alias("none"),
        )
        .first()
    )
    assert row.p == pytest.approx(6.38e-14, rel=1e-3)
    assert row.low == pytest.approx(NormalDist().cdf(-1)) and row.low + row.high == pytest.approx(1)
    assert row.none is None
    assert critical_value(0.05) == pytest.approx(1.959964, abs=1e-6)


@pytest.mark.parametrize("alpha", [0, 1, -0.1, 2])
def test_alpha_must_be_a_probability(alpha):
    with pytest.raises(ValueError):
        critical_value(alpha)


def test_six_digits(spark):
    values = [math.pi * 1e-9, 123456789.0, 0.0, -7.1597649, 1e300, None]
    rows = (
        spark.createDataFrame([(v,) for v in values], "v double")
        .select("v", six_digits(F.col("v")).alias("r"))
        .collect()
    )
    for row in rows:
        assert row.r == (None if row.v is None else float(f"{row.v:.6g}"))


def test_round_report_leaves_other_types_alone(spark):
    df = spark.createDataFrame([(1.23456789, 7, "x")], "a double, `b.c` long, d string")
    assert tuple(round_report(df).first()) == (1.23457, 7, "x")


def test_ratio_by_zero_is_null(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_blocked_and_allowed_names(spark):
    names = BLOCKED + ALLOWED
    flags = (
        spark.createDataFrame([(n,) for n in names], "n string")
        .select("n", is_blocked(F.col("n")).alias("b"))
        .collect()
    )
    assert [r.n for r in flags if r.b] == BLOCKED
    assert blocked_names(names) == BLOCKED


def test_blocked_names_keep_their_order():
    assert blocked_names(["a", "email", "b", "first_name", "plan_name"]) == ["email", "first_name"]


def test_extras_add_to_the_policy(spark):
    def flag(name, *extras):
        column = spark.range(1).select(is_blocked(F.lit(name), extras).alias("b")).first().b
        assert column == bool(blocked_names([name], extras))
        return column

    assert not flag("internal_score")
    assert flag("internal_score", "score")
    assert flag("account_secret_key", "Secret + key")
    assert not flag("secret_sauce", "secret+key")
    assert flag("email", "score")


@pytest.mark.parametrize("pattern", ["a+b+c", "", "+", "two words"])
def test_patterns_that_cannot_match_are_refused(pattern):
    with pytest.raises(ValueError):
        pattern_key(pattern)


def test_null_and_empty_names_pass(spark):
    df = spark.createDataFrame([(None,), ("",), ("__",)], "n string")
    assert [r.b for r in df.select(is_blocked(F.col("n")).alias("b")).collect()] == [False] * 3


def by_tokens(name):
    toks = re.findall("[a-z0-9]+", name.lower())
    pairs = {f"{a}+{b}" for a, b in zip(toks, toks[1:])}
    return bool(set(toks) & set(SINGLE_TOKENS) or pairs & set(TOKEN_PAIRS) or toks == ["name"])


@settings(max_examples=40, deadline=None)
@given(
    st.lists(
        st.lists(st.sampled_from(["e", "mail", "email", "First", "name", "ip", "zip", "code", "tax", "id", "_", "__", "-", " ", "\n", "é", "1", ""]), max_size=6)
        .map("".join),
        min_size=1,
        max_size=40,
    )
)
def test_all_forms_of_the_policy_agree(spark, names):
    policy = F.array(*[F.lit(k) for k in policy_keys()])
    rows = (
        spark.createDataFrame([(n,) for n in names], "n string")
        .select(
            "n",
            is_blocked(F.col("n")).alias("pattern"),
            F.arrays_overlap(name_keys(F.col("n")), policy).alias("keys"),
        )
        .collect()
    )
    for row in rows:
        expected = by_tokens(row.n)
        assert row.pattern == row.keys == bool(blocked_names([row.n])) == expected


def test_name_conventions():
    assert all(map(is_date_name, ["d", "DT", "date", "day", "ds", "signup_date", "event_ts", "closed_at"]))
    assert not any(map(is_date_name, ["update", "ts", "n", "birthday"]))
    assert all(map(is_denominator_name, ["n", "N", "n_users", "users_n"]))
    assert not any(map(is_denominator_name, ["count", "nn", "name"]))
    assert view_name("Weekly Deploys") == "weekly_deploys"
    assert view_name("2024-q1") == "t_2024_q1"
    assert view_name("--") == "t_"
