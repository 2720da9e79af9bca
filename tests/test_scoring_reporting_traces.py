"""Verdict blocks, scores, report tables and trace lines."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from movecheck.functions.verdicts import verdict_entries
from movecheck.operators import reporting, scoring, traces
from movecheck.sources import files

BLOCK = """# Verdicts

```yaml
# machine-verdicts v1
case: demo
verdicts:
  H1: {verdict: SURVIVED}
  H2: {verdict: KILLED}
  H3: {verdict: UNDERPOWERED}
  H4: {verdict: KILLED}
  H-prior: {verdict: KILLED}
```
"""
ALL = {"H1": "SURVIVED", "H2": "KILLED", "H3": "UNDERPOWERED", "H4": "KILLED", "H-prior": "KILLED"}


def body(entries, opening="```yaml\n"):
    return f"text\n\n{opening}# machine-verdicts v1\ncase: x\nverdicts:\n{entries}```\nmore\n"


@pytest.mark.parametrize(
    "text,expected",
    [
        (BLOCK, ALL),
        (BLOCK.replace("\n", "\r\n"), ALL),
        (body("  H1: KILLED\n", "```\n"), {"H1": "KILLED"}),
        (body("  H1: KILLED\n", "```yml\n"), {"H1": "KILLED"}),
        (body("  H1: KILLED\n", "```json\n"), {}),
        (body("  # why\n\n  \"H1\": 'KILLED'  # note\nother: 1\n  H2: KILLED\n"), {"H1": "KILLED"}),
        (body("  H1: {note: x, verdict: KILLED, by: y}\n"), {"H1": "KILLED"}),
        (body("  H1: KILLED\n  H2: KILLED\n  H1: SURVIVED\n"), {"H1": "SURVIVED", "H2": "KILLED"}),
        ("```\nother\n```\n" + body("  H1: KILLED\n"), {"H1": "KILLED"}),
        (body("  H1: KILLED\n") + body("  H1: SURVIVED\n"), {"H1": "KILLED"}),
        (body("  H1: KILLED\n  H2: [unclosed\n"), {}),
        (body("  H1:\n    verdict: KILLED\n  H2: KILLED\n"), {"H1": "KILLED", "H2": "KILLED"}),
        (body("  \"H1\":  # why\n    note: x\n\n    # more\n    verdict: 'KILLED'  # so\n    by:\n      - y\n"), {"H1": "KILLED"}),
        (body("  H1:\n      by: y\n      verdict: KILLED\n  H2:\n    verdict: SURVIVED\n"), {"H1": "KILLED", "H2": "SURVIVED"}),
        (body("  H1:\n    note: x\n  H2: KILLED\n"), {}),
        (body("  H1:\n  verdict: KILLED\n"), {}),
        (body(""), {}),
        ("no block here", {}),
        ("```yaml\nnot: [valid\n```", {}),
        ("machine-verdicts v1 without a fence", {}),
        (None, {}),
    ],
)
def test_extract(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert dict(df.select(verdict_entries(F.col("t")).alias("v")).first().v) == expected


def test_extract_survives_long_documents(spark):
    prose = "word ``` " * 50_000
    entries = "".join(f"  H{i}: KILLED\n" for i in range(20_000))
    spread = "".join(f"  S{i}:\n    verdict: KILLED\n    by: y\n" for i in range(20_000))
    noted = "  T:\n" + "    note: y\n" * 20_000 + "    verdict: KILLED\n" + "    note: z\n" * 20_000
    df = spark.createDataFrame([(body(entries + spread + noted) + prose,)], "t string")
    assert scoring.extract_verdicts(df.withColumn("k", F.lit(1)), key=["k"], text="t").count() == 40_001


SCENARIO = {
    "id": "0001-demo", "case": "demo", "matching_hypothesis": "H1", "distractors": ["H-prior", "H4"],
    "expected_verdicts": {"H1": ["SURVIVED"], "H2": ["KILLED", "UNDERPOWERED"], "H3": ["KILLED", "UNDERPOWERED"], "H4": ["KILLED"], "H-prior": ["KILLED"]},
}


def score(spark, text, tmp_path, **changes):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({**SCENARIO, **changes}) + "\n")
    documents = spark.createDataFrame([("demo", text)], "case string, text string")
    verdicts = scoring.verdict_maps(documents, case="case", text="text")
    row = scoring.score_scenarios(files.read_scenarios(spark, str(path)), verdicts).first()
    return tuple(row[m] for m in scoring.MARKS), row.score


@pytest.mark.parametrize(
    "old,new,changes,marks",
    [
        ("", "", {}, (True, True, True, True)),
        ("H2: {verdict: KILLED}", "H2: {verdict: SURVIVED}", {}, (True, True, False, False)),
        ("H-prior: {verdict: KILLED}", "H-prior: {verdict: UNDERPOWERED}", {}, (True, False, True, False)),
        ("H-prior: {verdict: KILLED}", "H-prior: {verdict: UNDERPOWERED}", {"distractors": ["H4"]}, (True, True, True, False)),
        ("H-prior: {verdict: KILLED}", "H-prior: {verdict: UNDERPOWERED}", {"distractors": None}, (True, True, True, False)),
        ("", "", {"matching_hypothesis": "none — missed"}, (False, True, True, True)),
        ("", "", {"matching_hypothesis": "H9"}, (False, True, True, True)),
        ("  H1: {verdict: SURVIVED}\n", "", {}, (False, True, False, False)),
        ("H1: {verdict: SURVIVED}", "H1: {verdict: UNDERPOWERED}", {}, (False, True, False, False)),
        ("", "", {"expected_verdicts": None}, (True, True, True, True)),
        ("", "", {"expected_verdicts": {"H9": ["KILLED"]}}, (True, True, True, False)),
        ("# machine-verdicts v1", "", {}, (False, False, False, False)),
        ("", "", {"case": "another"}, (False, False, False, False)),
    ],
)
def test_truth_table(spark, tmp_path, old, new, changes, marks):
    assert score(spark, BLOCK.replace(old, new) if old else BLOCK, tmp_path, **changes) == (
        marks, f"{sum(marks)}/4"
    )


def test_gate(spark):
    scores = spark.createDataFrame([(4,), (4,)], "points int")
    assert scoring.score_gate(scores).first().passed
    assert not scoring.score_gate(scores.union(spark.createDataFrame([(3,)], "points int"))).first().passed
    assert tuple(scoring.score_gate(scores.limit(0)).first()) == (0, 0, True)


def test_query_index(spark, tmp_path):
    def guard(name, status, rows, sql, checks):
        (tmp_path / f"{name}.guard.json").write_text(
            json.dumps({"version": 1, "case": "c", "sqlfile": "q", "sql": sql, "dialect": "d", "executed_at": "t",
                        "row_count": rows, "columns": [], "source_row_counts": {}, "checks": checks, "status": status}, indent=2)
        )

    for stem in ("h1_ok", "h2_bad", "h3_none"):
        (tmp_path / f"{stem}.sql").write_text(f"SELECT '{stem}'")
    guard("h1_ok", "pass", 25, "SELECT executed", [{"id": "G-6", "name": "window-coverage", "status": "pass"}])
    guard("h2_bad", "error", None, "", [
        {"id": "G-6", "name": "window-coverage", "status": "error"}, {"id": "G-8", "status": "warn"}])
    reports = files.read_reports(spark, str(tmp_path / "*.guard.json"))
    assert {c.detail for r in reports.collect() for c in r.checks} == {""}
    index = reporting.query_index(files.read_queries(spark, str(tmp_path / "*.sql")), reports)
    assert [tuple(r) for r in index.collect()] == [
        ("h1_ok.sql", "pass", "SELECT executed", 25, [], "results/h1_ok"),
        ("h2_bad.sql", "error", "SELECT 'h2_bad'", None, ["window-coverage", "G-8"], None),
        ("h3_none.sql", "missing", "SELECT 'h3_none'", None, [], None),
    ]


def test_inventory_counts_records_not_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,z\n\n')
    (tmp_path / "b.csv").write_text("only\n")
    (tmp_path / "c.csv").write_text("x\n1\n2\n")
    pattern = str(tmp_path / "*.csv")
    (tmp_path / "d %2B+.csv").write_text("x\n1\n")
    listing = files.list_result_files(spark, pattern)
    out = reporting.result_inventory(files.read_result_rows(spark, pattern), listing)
    assert {r.file: r.n_rows for r in out.collect()} == {"a.csv": 2, "b.csv": 0, "c.csv": 2, "d %2B+.csv": 1}


def test_inventory_counts_a_folder_of_part_files_as_one_result(spark, tmp_path):
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "h1 a"))
    spark.range(0).write.parquet(str(tmp_path / "h2"))
    paths = [str(tmp_path / "h1 a"), str(tmp_path / "h2")]
    rows = files.read_result_rows(spark, paths, format="parquet")
    out = reporting.result_inventory(rows, files.list_result_files(spark, paths)).collect()
    assert sorted((r.file, r.n_rows) for r in out) == [("h1 a", 90), ("h2", 0)]


def test_preview(spark):
    df = spark.range(65).select("id", F.when(F.col("id") < 25, "long").when(F.col("id") < 30, "short").alias("t"))
    out = reporting.preview(df, order=[F.col("id").desc()], by=["t"]).collect()
    shown = {t: [r for r in out if r.t == t] for t in ("long", "short", None)}
    assert {t: len(r) for t, r in shown.items()} == {"long": 20, "short": 5, None: 20}
    assert {(r.t, r.total_rows, r.truncated) for r in out} == {("long", 25, True), ("short", 5, False), (None, 35, True)}
    assert min(r.id for r in shown["long"]) == 5
    alone = reporting.preview(df, order=[F.col("id")]).orderBy("position").collect()
    assert [r.id for r in alone] == list(range(20)) and alone[0].total_rows == 65 and alone[0].truncated
    plan = reporting.preview(df, order=[F.col("id")], by=["t"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_preview_is_cut_before_the_shuffle(spark):
    kept = spark.conf.get(reporting.GROUP_LIMIT)
    df = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 2 == 0).alias("t"))
    try:
        out = reporting.preview(df, order=[F.col("id").desc()], by=["t"], limit=5000)
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
        got = out.groupBy("t").agg(F.count(F.lit(1)), F.min("id"), F.max("position"), F.bool_and("truncated"))
        assert sorted(map(tuple, got.collect())) == [(False, 5000, 10_001, 5000, True), (True, 5000, 10_000, 5000, True)]
    finally:
        spark.conf.set(reporting.GROUP_LIMIT, kept)


RECORD = {k: "x" for k in traces.REQUIRED_KEYS} | {
    "intake": 'long "prose"\nwith breaks\tand email words ' * 3000,
    "hypotheses": [{"id": "H1", "sql": "SELECT n", "guard": "pass", "verdict": "KILLED"}],
    "scores": {"found_true_cause": True},
    "ground_truth": None,  # present, if null
}


@pytest.mark.parametrize(
    "change,missing,blocked",
    [
        ({}, [], []),
        ({"created": ...}, ["created"], []),
        ({"scores": {"email": True}}, [], ["email"]),
        ({"hypotheses": [{"id": [{"deep": "first_name"}]}]}, [], ["first_name"]),
        ({"schema_summary": "contact.email"}, [], ["contact.email"]),
        ({"schema_summary": 'a"zip\\'}, [], ["a␛zip␛"]),
        ({"schema_summary": "email " + "x"}, [], []),  # prose
        ({"schema_summary": "email_" + "x" * 59}, [], []),  # too long for a name
        ({"schema_summary": "email_" + "x" * 58}, [], ["email_" + "x" * 58]),
        ({"schema_summary": "firsténame"}, [], ["firsténame"]),
    ],
)
@pytest.mark.parametrize("ascii_only", [True, False])
def test_trace_lines(spark, change, missing, blocked, ascii_only):
    record = {k: v for k, v in {**RECORD, **change}.items() if v is not ...}
    line = json.dumps(record, ensure_ascii=ascii_only)
    row = traces.trace_contract(spark.createDataFrame([(line,)], "value string")).first()
    assert row.parses and row.missing == missing and row.blocked == blocked
    assert row.valid == (not missing and not blocked)


@pytest.mark.parametrize("line", ["not json", '{"id": "cut', "[1]", ""])
def test_lines_that_are_not_records(spark, line):
    row = traces.trace_contract(spark.createDataFrame([(line,)], "value string")).first()
    assert not row.parses and not row.valid and row.missing is None


def test_escaped_names_are_read_unescaped(spark):
    line = json.dumps({"k": "x"}).replace('"x"', '"\\u0065mail"')
    found = spark.createDataFrame([(line,)], "v string").select(traces.blocked_tokens(F.col("v")).alias("b"))
    assert found.first().b == ["email"]


def test_many_escapes_do_not_exhaust_the_stack(spark):
    line = json.dumps({**RECORD, "intake": '"\n' * 200_000})
    assert traces.trace_contract(spark.createDataFrame([(line,)], "value string")).first().valid
