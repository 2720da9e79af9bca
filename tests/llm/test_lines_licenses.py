"""Line spread and licence digests: the SQL, planted cases and edge rows."""

import sys
import textwrap
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from movecheck.llm import license_scan, line_dedup, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    n, problems = oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert n and not problems


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, pos int")


def _cleaned(df, **options):
    return {r.doc_id: (r.text, r["__lines"], r["__removed"]) for r in line_dedup.without_boilerplate(df, **options).collect()}


def test_boilerplate_stays_once(spark):
    rows = [(i, f"own {i}\n  Accept all cookies \nend {i}", f"site{i % 12}", i) for i in range(40)]
    rows += [(100 + i, "rare line\nx" + str(i), f"site{i % 9}", i) for i in range(30)]
    out = _cleaned(_docs(spark, rows))
    assert out[0] == ("own 0\n  Accept all cookies \nend 0", 3, 0)
    assert all(out[i] == (f"own {i}\nend {i}", 3, 1) for i in range(1, 40))
    assert all(out[100 + i] == ("rare line\nx" + str(i), 2, 0) for i in range(30))


def test_threshold_is_exact(spark):
    rows = [(100 * sites + i, f"line of {sites}", f"s{i}", 0) for sites in range(7, 14) for i in range(sites)]
    out = _cleaned(_docs(spark, rows))
    removed = {sites: sum(out[100 * sites + i][2] for i in range(sites)) for sites in range(7, 14)}
    assert removed == {7: 0, 8: 0, 9: 0, 10: 9, 11: 10, 12: 11, 13: 12}


def test_many_sites_near_a_high_threshold(spark):
    rows = [(i, "few" if i < 480 else "many", f"s{i}", 0) for i in range(480 + 500)]
    out = _cleaned(_docs(spark, rows), min_sites=500, lg_k=8)
    assert sum(v[2] for k, v in out.items() if k < 480) == 0
    assert sum(v[2] for k, v in out.items() if k >= 480) == 499


def test_line_edge_rows(spark):
    rows = [(i, "shared\n\nshared", f"s{i}", i) for i in range(10)]
    rows += [(None, "shared", "t", 0), (50, None, "t", 0), (51, "", "t", 0), (52, "\n \n", "t", 0), (53, "shared\nx", None, 0), (9, "shared\ny", "t", 0)]
    found = line_dedup.without_boilerplate(_docs(spark, rows))
    assert found.columns == ["doc_id", "text", "source", "pos", "__lines", "__removed"]
    out = sorted(((r.doc_id, r.text, r["__lines"], r["__removed"]) for r in found.collect()), key=str)
    wanted = [(0, "shared\n\nshared", 2, 0)] + [(i, "", 2, 2) for i in range(1, 9)]
    wanted += [(None, "shared", 1, 0), (50, None, 0, 0), (51, "", 0, 0), (52, "\n \n", 0, 0), (53, "x", 2, 1)]
    rest = [r for r in out if r[0] == 9]
    assert sorted([r for r in out if r[0] != 9], key=str) == sorted(wanted, key=str) and len(rest) == 2
    assert line_dedup.without_boilerplate(_docs(spark, rows).limit(0)).count() == 0


def test_license_spellings():
    mit = license_scan.LICENSES["MIT"]
    changed = "Copyright (c) 1999 Jane Doe\n(c) 2001 Others. All rights reserved.\n\n" + mit.upper().replace('"', "``").replace("SUBLICENSE", "Sublicence")
    assert license_scan.digest(changed) == license_scan.digest(mit)
    assert license_scan.digest(mit + " More.") != license_scan.digest(mit)
    assert license_scan.canonical("The LICENCE, its https://x & owners' Programme!") == "the license its http x holders program"
    assert len({license_scan.digest(t) for t in license_scan.LICENSES.values()}) == len(license_scan.LICENSES)


NOTICES = ["Copyright (c) 1999 Jane Doe", "Copyright 2001-2004 A. B.", "# Copyright: \u00a9 Acme", "(c) 2010 Others, all of them", "\u00a9 Jane", "Copyright [yyyy] someone", "  All rights reserved.\r"]


def test_only_notices_are_dropped():
    for line in NOTICES:
        assert license_scan.canonical(f"before\n{line}\nafter") == "before after", line
    for line in ["COPYRIGHT HOLDERS BE LIABLE", "copyright notice and this", "(c) You must retain", "Copyright law applies", "all rights reserved to him"]:
        assert line.split()[-1].lower() in license_scan.canonical(f"before\n{line}\nafter"), line


def test_licenses_at_any_width():
    for name, text in license_scan.LICENSES.items():
        wanted = license_scan.digest(text)
        paragraphs = text.split("\n\n")
        for width in (50, 60, 70, 72, 76, 78, 79, 80, 100, 120, 200, 10**9):
            for parts in ([text], paragraphs):
                wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in parts)
                assert license_scan.digest(wrapped) == wanted, (name, width)
                assert license_scan.digest("Copyright (c) 2020 Jane Doe\n\n" + wrapped) == wanted, (name, width)


def test_planted_licenses_are_found(spark):
    texts = license_scan.LICENSES
    assert {"Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(texts)
    names = sorted(texts)
    rows = [(i, "(c) 2020 Jane Doe\n" + textwrap.fill(texts[name], 60 + i)) for i, name in enumerate(names)]
    rows += [(1000, f"MIT License\n\nCopyright (c) 2020 Jane\n\n{texts['MIT']}"), (1001, "A page.\n" + texts["MIT"])]
    rows += [(1002, "This work is licensed under the GNU General Public License, version 3."), (1003, "Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i] for i in range(len(names))] == names
    assert [found[i] for i in range(1000, 1004)] == ["MIT-titled-1", None, "GPL-3.0-notice", "CC-BY-NC-4.0-notice"]


def test_license_edge_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "...", "k"), (4, "RELEASED under the MIT licence", "k"), (4, "Released under the MIT License", "k"), (5, "x " * 100_000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, license_id string")
    out = license_scan.scan(df)
    assert sorted((r.doc_id, r.license_id or "") for r in out.collect()) == [(1, ""), (2, ""), (3, ""), (4, "MIT-notice"), (4, "MIT-notice"), (5, "")]
    own = spark.createDataFrame([("b", license_scan.digest("x y")), ("a", license_scan.digest("X, Y")), ("c", license_scan.digest(""))], "license_id string, digest string")
    texts = spark.createDataFrame([(1, "x\ny"), (2, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.license_id for r in license_scan.scan(texts, own).collect()} == {1: "a", 2: None}
    assert license_scan.scan(df.limit(0)).count() == 0
