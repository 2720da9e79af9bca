"""SQL text meets registered views only: every other way to a source, and reflection, is refused."""

from __future__ import annotations

import pytest

from movecheck.operators import policy
from movecheck.sources import tables
from movecheck.sources.enforcement import QueryRefused

PROPERTY = "movecheck.enforcement.test"


@pytest.fixture
def shop(spark, tmp_path):
    """Buyers with an address, as a registered view, a raw file and an unregistered view."""
    buyers = spark.createDataFrame(
        [(1, "x@shop.example", "north", ("a@b.example", 3)), (2, "y@shop.example", "south", ("c@d.example", 4))],
        "buyer_id int, email string, region string, contact struct<email:string,level:int>",
    )
    path = str(tmp_path / "buyers.parquet")
    buyers.write.parquet(path)
    raw = spark.read.parquet(path)
    policy.register(raw, "buyers")
    raw.createOrReplaceTempView("raw_buyers")
    raw.createOrReplaceGlobalTempView("raw_buyers")
    yield path
    for name in ("buyers", "raw_buyers"):
        spark.catalog.dropTempView(name)
    spark.catalog.dropGlobalTempView("raw_buyers")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT email AS reach FROM raw_buyers",
        "SELECT region FROM raw_buyers",
        "SELECT b.region FROM buyers b WHERE EXISTS (SELECT 1 FROM raw_buyers r WHERE r.buyer_id = b.buyer_id)",
        "SELECT region, (SELECT max(region) FROM raw_buyers) AS m FROM buyers",
        "SELECT region FROM buyers WHERE buyer_id IN (SELECT buyer_id FROM global_temp.raw_buyers)",
        "WITH r AS (SELECT region FROM raw_buyers) SELECT region FROM buyers UNION ALL SELECT region FROM r",
        "SELECT l.region FROM buyers b, LATERAL (SELECT r.region FROM raw_buyers r WHERE r.buyer_id = b.buyer_id) l",
        "SELECT region FROM buyers ORDER BY (SELECT count(*) FROM raw_buyers)",
        "FROM raw_buyers |> SELECT region",
    ],
)
def test_other_sources_are_refused(spark, shop, text):
    with pytest.raises(QueryRefused, match="G-5 redaction: not a registered view: .*raw_buyers"):
        tables.run_query(spark, text)


@pytest.mark.parametrize("allowed", ["false", "true"])
@pytest.mark.parametrize(
    "text",
    [
        "SELECT email AS reach FROM parquet.`{}`",
        "SELECT region FROM buyers WHERE buyer_id IN (SELECT buyer_id FROM parquet.`{}`)",
        "SELECT value FROM text.`{}`",
        "SELECT content FROM binaryFile.`{}/*`",
    ],
)
def test_paths_are_refused_whatever_the_session_allows(spark, shop, text, allowed):
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    assert before == "false"
    spark.conf.set("spark.sql.runSQLOnFiles", allowed)
    try:
        with pytest.raises(QueryRefused, match="G-5 redaction: not a registered view: "):
            tables.run_query(spark, text.format(shop))
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT reflect('java.lang.System', 'setProperty', '{}', 'x') AS a",
        "SELECT JAVA_METHOD('java.lang.System', 'setProperty', '{}', 'x') AS a FROM buyers",
        "SELECT try_reflect('java.lang.System', 'setProperty', '{}', 'x') AS a",
        "SELECT region FROM buyers WHERE EXISTS (SELECT reflect('java.lang.System', 'setProperty', '{}', 'x'))",
        "WITH c AS (SELECT reflect('java.lang.System', 'setProperty', '{}', 'x') AS a) SELECT 1 AS n",
        "SELECT id FROM range(length(reflect('java.lang.System', 'setProperty', '{}', 'x')))",
        "SELECT region FROM buyers LIMIT length(reflect('java.lang.System', 'setProperty', '{}', 'x'))",
        "SELECT region FROM IDENTIFIER(reflect('java.lang.System', 'setProperty', '{}', 'x'))",
        "SELECT transform(array(1), v -> reflect('java.lang.System', 'setProperty', '{}', 'x')) AS a",
    ],
)
def test_reflection_is_refused_before_analysis(spark, shop, text):
    with pytest.raises(QueryRefused, match="G-2 select-only: reflective calls"):
        tables.run_query(spark, text.format(PROPERTY))
    assert spark._jvm.java.lang.System.getProperty(PROPERTY) is None


def test_the_plan_alone_refuses_what_it_reads(spark, shop):
    from movecheck.sources import enforcement

    spark.sql("CREATE OR REPLACE TEMP VIEW made AS SELECT region FROM raw_buyers")
    for other in ("SELECT region FROM made", "SELECT region FROM raw_buyers"):
        with pytest.raises(QueryRefused, match="not a registered view: view"):
            enforcement.check_sources(spark.sql(other))
    with pytest.raises(QueryRefused, match="not a registered view: Relation"):
        enforcement.check_sources(spark.read.parquet(shop))
    spark.catalog.dropTempView("made")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT contact.email AS reach FROM buyers",
        "SELECT count(*) AS n FROM buyers WHERE contact.email LIKE '%x%'",
        "SELECT array(contact).email AS reach FROM buyers",
        "SELECT u.region FROM (SELECT region, region AS email FROM buyers) u JOIN buyers b ON u.email = b.region",
    ],
)
def test_blocked_names_are_refused_wherever_they_are_used(spark, shop, text):
    with pytest.raises(QueryRefused, match="G-5 redaction: personal columns: email"):
        tables.run_query(spark, text)


def test_extras_count_as_well(spark, shop):
    assert tables.run_query(spark, "SELECT max(region) AS m FROM buyers").first().m == "south"
    with pytest.raises(QueryRefused, match="personal columns: region"):
        tables.run_query(spark, "SELECT max(region) AS m FROM buyers", ["region"])


def test_a_view_put_in_the_place_of_a_registered_one_is_refused(spark, shop):
    spark.read.parquet(shop).selectExpr("buyer_id", "email AS region").createOrReplaceTempView("buyers")
    with pytest.raises(QueryRefused, match="not a registered view: view buyers"):
        tables.run_query(spark, "SELECT region FROM buyers")


@pytest.mark.parametrize(
    "text,n",
    [
        ("SELECT 1 AS a", 1),
        ("SELECT a FROM VALUES (1), (2) AS t(a)", 2),
        ("SELECT id FROM range(3)", 3),
        ("SELECT explode(array(1, 2)) AS a FROM buyers", 4),
        ("SELECT contact.level FROM buyers", 2),
        ("WITH c AS (SELECT region FROM buyers), d AS (SELECT * FROM c) SELECT * FROM d, c", 4),
        ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT n FROM t", 4),
        ("SELECT region, row_number() OVER (ORDER BY buyer_id) AS r FROM buyers TABLESAMPLE (100 PERCENT)", 2),
        ("SELECT * FROM buyers PIVOT (count(buyer_id) FOR region IN ('north', 'south'))", 2),
    ],
)
def test_queries_over_registered_views_run(spark, shop, text, n):
    assert tables.run_query(spark, text).count() == n
