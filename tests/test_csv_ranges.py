"""CSV files cut into byte ranges give the rows that one task gives."""

import csv
import random

import pytest
from pyspark.sql import types as T

from movecheck.sources import csv_ranges
from movecheck.sources.csv_ranges import DIALECT, open_after, read_split
from movecheck.sources.tables import register_folder


@pytest.fixture
def tiny_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    old = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def as_one_task(spark, path, **options):
    return spark.read.options(header=True, **DIALECT, **options).csv(str(path))


def same(spark, path):
    ours, theirs = read_split(spark, str(path)), as_one_task(spark, path, inferSchema=True)
    assert ours.dtypes == theirs.dtypes
    assert sorted(ours.collect(), key=repr) == sorted(theirs.collect(), key=repr)
    return ours


def scan(text, inside):
    """Character by character, for comparison."""
    first = not inside
    i = 0
    while i < len(text):
        if inside:
            if text[i] == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside, first = False, False
        elif text[i] == '"' and first:
            inside = True
        else:
            first = text[i] == ","
        i += 1
    return inside


def test_state_after_a_line():
    rng = random.Random(5)
    for _ in range(20_000):
        line = "".join(rng.choice('",a') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            assert open_after(line, inside) == scan(line, inside), (line, inside)


def test_random_texts_across_ranges(spark, tiny_ranges, tmp_path):
    rng = random.Random(7)
    path = tmp_path / "t.csv"
    alphabet = ['"', ",", "\n", "a", "é", " ", "\n\n", '",', ',"', "\r\n", "\r"]
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator="\n")
        out.writerow(["id", "text", "n"])
        for i in range(60):
            out.writerow([i, "x" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) + "x", rng.randrange(9)])
        out.writerow([60, "long " + 'line\n"quoted" ' * 60, 1])
        out.writerow([61, "last", 2])
    ours = same(spark, path)
    assert ours.count() == 62
    assert csv_ranges._lines(spark, str(path)).select("start").distinct().count() >= 10


def test_edges(spark, tiny_ranges, tmp_path):
    long = "y" * 150
    files = {
        "stray": f'a,b\n5" pipe,1\nx,"{long}\n"\n6" pipe,2\n',
        "crlf": f'a,b\r\n1,"x\r\n{long}"\r\n\r\n2,z\r\n',
        "blank": f'\n\na,b\n\n1,"\n\n{long}\n\n"\n\n',
        "bom": f'﻿a,b\n1,"{long}\n"\n2,\n',
        "heading": f'"a\n{long}",b\n1,2\n3,""\n',
        "repeated_heading": f"a,b\n1,{long}\na,b\na,b\n",
        "no_end": f'a,b\n1,{long}\n2,"z\nz"',
        "short_row": f"a,b,c\n1\n2,{long},7\n",
        "only_heading": "a,b\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        same(spark, tmp_path / f"{name}.csv")


def test_part_files_and_schema(spark, tiny_ranges, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for part in range(3):
        rows = "".join(f'{part}{i},"a\n""{i}"", {"b" * i}"\n' for i in range(40))
        (folder / f"part-{part}.csv").write_text("k,t\n" + rows)
    (folder / "part-9.csv").write_text("")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    ours = read_split(spark, str(folder), schema)
    assert ours.schema == schema and ours.count() == 120
    theirs = spark.read.options(header=True, **DIALECT).schema(schema).csv(str(folder))
    assert sorted(ours.collect()) == sorted(theirs.collect())


def test_folder_reads_long_files_by_ranges(spark, tiny_ranges, tmp_path):
    (tmp_path / "long.csv").write_text("user_id,email,note\n" + '7,a@b,"two\nlines"\n' * 40)
    (tmp_path / "short.csv").write_text('user_id,note\n7,"two\nlines"\n')
    found = register_folder(spark, str(tmp_path))
    assert found["long"].columns == found["short"].columns == ["user_id", "note"]
    assert found["long"].dtypes == found["short"].dtypes
    assert [tuple(r) for r in found["long"].collect()] == [(7, "two\nlines")] * 40
    assert "MapInArrow" in found["long"]._jdf.queryExecution().toString()
    assert "MapInArrow" not in found["short"]._jdf.queryExecution().toString()


def test_unclosed_text_reaches_the_end(spark, tiny_ranges, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('a,b\n1,"' + "z,\n" * 60)
    assert csv_ranges.csv_records(spark, str(path)).count() == 2


def test_too_many_ranges(spark, tiny_ranges, tmp_path, monkeypatch):
    (tmp_path / "m.csv").write_text("a\n" + "1\n" * 200)
    monkeypatch.setattr(csv_ranges, "MAX_RANGES", 2)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        read_split(spark, str(tmp_path / "m.csv"))
