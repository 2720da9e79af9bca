"""Folders of tables, policy at the source, records around a query."""

from __future__ import annotations

from datetime import date

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from movecheck.operators import policy
from movecheck.sources import files, tables


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


@pytest.fixture
def folder(tmp_path):
    put(tmp_path / "users.csv", "user_id,email,platform\nu1,a@ex.com,ios\nu2,b@ex.com,android\n")
    put(tmp_path / "Weekly Deploys.csv", "date,component\n2025-04-05,ios-client\n")
    put(
        tmp_path / "subs.csv",
        "user_id,started_at,seen,mrr,canceled_at\n1,2025-01-06,2025-01-06T09:00:00,8.0,\n2,2025-01-07,2025-01-07T10:30:00,20.5,2025-03-01\n",
    )
    return tmp_path


def test_csv_folder_becomes_views(spark, folder):
    found = tables.register_folder(spark, str(folder))
    assert list(found) == ["weekly_deploys", "subs", "users"]  # by file name
    assert tables.run_query(spark, "SELECT count(*) AS n FROM weekly_deploys").first().n == 1
    kinds = dict(found["subs"].dtypes)
    assert kinds == {
        "user_id": "int", "started_at": "date", "seen": "timestamp", "mrr": "double", "canceled_at": "date"
    }
    assert [r.canceled_at for r in found["subs"].collect()] == [None, date(2025, 3, 1)]


def test_blocked_columns_never_reach_a_view(spark, folder):
    found = tables.register_folder(spark, str(folder), extras=["platform"])
    assert found["users"].columns == ["user_id"]
    assert spark.sql("SELECT * FROM users").columns == ["user_id"]
    for sql in (
        "SELECT email FROM users",
        "SELECT user_id FROM users WHERE email = 'x'",
        "SELECT count(*) FROM users GROUP BY email",
        "SELECT a.user_id FROM users a JOIN users b ON a.email = b.email",
    ):
        with pytest.raises(AnalysisException):
            spark.sql(sql)


def test_given_schema_and_parquet(spark, folder):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("email", T.StringType()), T.StructField("platform", T.StringType())])
    found = tables.register_folder(spark, str(folder), schemas={"users": schema})
    assert found["users"].columns == ["user_id", "platform"]
    out = folder / "parquet"
    found["users"].write.parquet(str(out / "Users.parquet"))
    again = tables.register_folder(spark, str(out / "Users.parquet"), format="parquet")
    assert sum(df.count() for df in again.values()) == 2


def test_odd_file_names(spark, tmp_path):
    for i, name in enumerate(["a%20b.csv", "c+d e.csv", "2024 é.csv"]):
        put(tmp_path / name, f"x\n{i}\n")
    found = tables.register_folder(spark, str(tmp_path))
    assert {n: df.first().x for n, df in found.items()} == {"a_20b": 0, "c_d_e": 1, "t_2024": 2}


def test_missing_folder_has_no_views(spark, tmp_path):
    assert tables.register_folder(spark, str(tmp_path / "none")) == {}


def test_view_name_collision_names_both_files(spark, tmp_path):
    put(tmp_path / "a-b.csv", "x\n1\n")
    put(tmp_path / "a_b.csv", "x\n2\n")
    with pytest.raises(tables.ViewNameCollision, match=r"a_b\.csv and a-b\.csv"):
        tables.register_folder(spark, str(tmp_path))


def test_counts_and_profile(spark, folder):
    found = tables.register_folder(spark, str(folder))
    raw = {"users": spark.read.option("header", True).csv(str(folder / "users.csv")), "subs": found["subs"]}
    counts = tables.count_rows({**raw, "none": raw["subs"].limit(0)})
    assert {r.table: r.n_rows for r in counts.collect()} == {"users": 2, "subs": 2, "none": 0}
    profile = tables.table_profile(spark, raw, extras=["mrr"]).orderBy("table", "ordinal").collect()
    assert [(r.table, r.column, r.blocked) for r in profile if r.blocked] == [
        ("subs", "mrr", True), ("users", "email", True)
    ]
    assert {r.n_rows for r in profile} == {2} and len(profile) == 8
    estimates = spark.createDataFrame([("users", 1000)], "table string, n_rows long")
    profile = tables.table_profile(spark, raw, counts=estimates).collect()
    assert {(r.table, r.n_rows) for r in profile} == {("users", 1000), ("subs", None)}


def test_catalog_with_extra_patterns(spark):
    catalog = spark.createDataFrame(
        [("t", 1, "account_secret_key"), ("t", 2, "secret_sauce"), ("u", 1, "internal_score"), ("u", 2, "email"), ("u", 3, None)],
        "table string, ordinal int, column string",
    )
    patterns = spark.createDataFrame([("secret+key",), ("score",)], "key string")
    flagged = policy.flag_catalog(catalog, patterns=patterns)
    assert {r.column: r.blocked for r in flagged.collect()} == {
        "account_secret_key": True, "secret_sauce": False, "internal_score": True, "email": True, None: False,
    }
    assert [r.column for r in policy.blocked_subset(flagged).collect()] == [
        "account_secret_key", "internal_score", "email"
    ]
    assert {r.table: (r.n_columns, r.n_blocked) for r in policy.catalog_summary(flagged).collect()} == {
        "t": (2, 1), "u": (3, 2)
    }


def test_pattern_file(spark, tmp_path):
    path = str(put(tmp_path / "extra.txt", "# per-case additions\nscore\n\n  Secret + key  \n"))
    assert files.load_patterns(spark, path) == ["score", "Secret + key"]
    assert [r.key for r in files.read_patterns(spark, path).collect()] == ["score", "secret+key"]
    assert files.load_patterns(spark, str(tmp_path / "absent.txt")) == []
    put(tmp_path / "extra.txt", "a+b+c\n")
    with pytest.raises(ValueError):
        files.load_patterns(spark, path)


def test_windows(spark):
    config = spark.createDataFrame(
        [("c", "focus", ["2025-03-23", "2025-04-21"]), ("c", "baseline", ["2025-02-09"]), ("c", "other", None),
         ("d", "focus", ["2025-03-23", "soon"]), ("d", "baseline", ["2025-02-09", "2025-03-10"])],
        "case string, kind string, bounds array<string>",
    )
    windows = files.analysis_windows(config)
    assert sorted((r.case, r.kind) for r in windows.collect()) == [("c", "focus"), ("d", "baseline")]
    assert files.focus_window(windows, "c") == (date(2025, 3, 23), date(2025, 4, 21))
    assert files.focus_window(windows, "d") is None


def test_jdbc_is_read_only_and_partitioned():
    plain = tables.jdbc_options("jdbc:postgresql://h/db", "events")
    assert plain["sessionInitStatement"] == "SET default_transaction_read_only = on"
    assert plain["queryTimeout"] == "60" and "numPartitions" not in plain
    split = tables.jdbc_options(
        "jdbc:postgresql://h/db", "events", partition_column="id", bounds=("0", "1000"), partitions=8
    )
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id", "0", "1000", "8"
    )
    assert "relname IN ('a', 'it''s')" in tables.estimate_query(["a", "it's"])


def test_estimates_that_say_nothing_are_null(spark):
    estimates = spark.createDataFrame([("a", 10), ("b", -1)], "table_name string, estimate long")
    got = {r.table: r.n_rows for r in tables.estimated_counts(estimates, ["a", "b", "c"]).collect()}
    assert got == {"a": 10, "b": None, "c": 0}


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é,\n\"x\"")], "n int, s string")
    for kind in ("parquet", "csv"):
        for _ in range(2):  # the second run replaces the first
            files.write_result(df, str(tmp_path / kind), format=kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == df.collect()
    back = spark.read.option("header", True).options(multiLine=True, escape='"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["n", "s"] and back.first().s == df.first().s
    other = duckdb.sql(f"SELECT n, s FROM read_csv('{tmp_path}/csv/*.csv', header=true)").fetchall()
    assert other == [(1, df.first().s)]


def test_documents_and_queries(spark, tmp_path):
    put(tmp_path / "h1 x+%41.sql", "SELECT 1\nFROM t\n")
    row = files.read_queries(spark, str(tmp_path / "*.sql")).first()
    assert (row.stem, row.file, row.sql) == ("h1 x+%41", "h1 x+%41.sql", "SELECT 1\nFROM t\n")
    put(tmp_path / "verdicts.md", "# é\n\ntext\n")
    assert files.read_documents(spark, str(tmp_path / "*.md")).first().text == "# é\n\ntext\n"


def test_traces(spark, tmp_path):
    put(tmp_path / "t.jsonl", '{"id": "1", "hypotheses": [{"id": "H1"}]}\n\n   \nnot json\n')
    rows = files.read_traces(spark, str(tmp_path / "t.jsonl")).orderBy(F.length("value").desc()).collect()
    assert len(rows) == 2 and rows[0].trace.hypotheses[0].id == "H1"
