"""Recorded verdicts scored against known answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movecheck.functions.columns import ident
from movecheck.functions.verdicts import verdict_entries

# The four marks of a scenario and the label of a missed cause.
MARKS = ("found_true_cause", "killed_the_false_prior", "artifact_checked", "honest_uncertainty")
MISSED = "none — missed"


def verdict_maps(documents: DataFrame, *, case: str, text: str) -> DataFrame:
    """One row per document with its verdicts as a map; an empty map if it has none."""
    return documents.select(
        ident(case).alias("case"), F.map_from_entries(verdict_entries(ident(text))).alias("verdicts")
    )


def extract_verdicts(documents: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """One row per verdict found in each document; documents without any give none."""
    return documents.select(
        *[ident(c) for c in key], F.inline(verdict_entries(ident(text)))
    )


def score_scenarios(scenarios: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Four marks and the score per scenario.

    ``scenarios`` has id, case, matching_hypothesis, distractors (array) and
    expected_verdicts (map to an array of accepted verdicts); ``verdicts`` one map per
    case. A case without verdicts scores 0.
    """
    found = verdicts.select(F.col("case").alias("__case"), F.col("verdicts").alias("__v"))
    joined = scenarios.join(found, F.col("case") == F.col("__case"), "left")
    v = F.col("__v")

    def verdict(hypothesis: str | Column) -> Column:
        return F.try_element_at(v, hypothesis if isinstance(hypothesis, Column) else F.lit(hypothesis))

    h1 = verdict("H1")
    other_survived = F.exists(
        F.map_entries(v), lambda e: (e["key"] != "H1") & (e["value"] == "SURVIVED")
    )
    matching = F.col("matching_hypothesis")
    has_prior = F.coalesce(F.array_contains("distractors", "H-prior"), F.lit(False))
    expected = F.coalesce(
        F.map_entries("expected_verdicts"),
        F.array().cast("array<struct<key:string,value:array<string>>>"),
    )
    marks = {
        "found_true_cause": (matching != MISSED) & (verdict(matching) == "SURVIVED"),
        "killed_the_false_prior": F.when(has_prior, verdict("H-prior") == "KILLED").otherwise(True),
        "artifact_checked": F.when(other_survived, h1 == "KILLED").otherwise(
            h1.isin("KILLED", "SURVIVED")
        ),
        "honest_uncertainty": F.forall(
            expected,
            lambda e: F.coalesce(F.array_contains(e["value"], verdict(e["key"])), F.lit(False)),
        ),
    }
    recorded = F.coalesce(F.size(v) > 0, F.lit(False))
    scored = joined.select(
        "id", "case", *[(recorded & F.coalesce(m, F.lit(False))).alias(k) for k, m in marks.items()]
    )
    full = sum((F.col(k).cast("int") for k in MARKS), F.lit(0))
    return scored.withColumn("points", full).withColumn(
        "score", F.concat(full.cast("string"), F.lit(f"/{len(MARKS)}"))
    )


def score_gate(scores: DataFrame) -> DataFrame:
    """Number of scenarios and whether all have full marks; none at all passes."""
    return scores.agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.count_if(F.col("points") == len(MARKS)).alias("full_marks"),
    ).withColumn("passed", F.col("scenarios") == F.col("full_marks"))
