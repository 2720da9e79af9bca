"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    """A value both engines spell the same way."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return str(value)


def _kind(arrow_type) -> str:
    text = str(arrow_type).replace("large_", "")
    if text.startswith("timestamp"):
        return "timestamp"
    if text.startswith("list"):
        return "list"
    return text


def rows(arrow) -> tuple[dict[str, str], list[str]]:
    names = sorted(arrow.column_names)
    kinds = {n: _kind(arrow.schema.field(n).type) for n in names}
    columns = [arrow.column(n).to_pylist() for n in names]
    return kinds, sorted(str([plain(v) for v in row]) for row in zip(*columns))


def compare(spark, function, sql: str, sf_dir: str, connection=None) -> tuple[int, list[str]]:
    """Number of rows and a list of differences (empty when all agree)."""
    connection = connection or connect(sf_dir)
    ours_kinds, ours = rows(function(spark, sf_dir).toArrow())
    theirs_kinds, theirs = rows(connection.sql(sql).to_arrow_table())
    problems = []
    if ours_kinds != theirs_kinds:
        differing = {
            k: (ours_kinds.get(k), theirs_kinds.get(k))
            for k in ours_kinds.keys() | theirs_kinds.keys()
            if ours_kinds.get(k) != theirs_kinds.get(k)
        }
        problems.append(f"types: {differing}")
    if ours != theirs:
        missing = [r for r in theirs if r not in set(ours)][:3]
        surplus = [r for r in ours if r not in set(theirs)][:3]
        problems.append(f"{len(ours)} rows against {len(theirs)}; missing {missing}; surplus {surplus}")
    return len(ours), problems
