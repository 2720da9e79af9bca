"""Cross-site boilerplate lines: HyperLogLog spread per line, exact counts near the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from movecheck.llm.common import broadcast_if_small, fresh, staged

#: Sites on which a line must stand to be boilerplate.
MIN_SITES = 10
#: Log2 of the sketch's buckets; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Standard errors around the threshold within which the estimate isn't trusted.
NEAR = 5.0
_SALT = "movecheck"


def _lines(docs: DataFrame, text: str, id: str, site: str) -> DataFrame:
    """Rows (id, site, pos, k1, k2) of every line that isn't blank; 128 bits name a line."""
    cut = docs.select(
        F.col(id).alias("id"),
        F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
    )
    line = F.btrim("line", F.lit(" \t\r\f\x0b"))
    return cut.withColumn("line", line).filter("line <> ''").select(
        "id", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(_SALT)).alias("k2")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Rows (k1, k2, first) of lines on at least ``min_sites`` distinct sites.

    The sketches of a line merge as partial aggregates, so a line in a third of all documents
    reaches its task as one sketch per input split. Estimates further than ``NEAR`` standard
    errors from the threshold decide; the lines in between are counted exactly, after their
    (line, site) pairs have been made distinct.
    """
    margin = NEAR * 1.04 / 2 ** (lg_k / 2)
    spread = staged(
        lines.groupBy("k1", "k2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about"), F.min("id").alias("first"))
        .filter(F.col("about") >= min_sites * (1 - margin))
    )
    clear = spread.filter(F.col("about") > min_sites * (1 + margin))
    near = broadcast_if_small(spread.filter(F.col("about") <= min_sites * (1 + margin)))
    pairs = lines.join(near.select("k1", "k2", "first"), ["k1", "k2"]).filter("site is not null")
    exact = pairs.select("k1", "k2", "first", "site").distinct().groupBy("k1", "k2", "first").count()
    return clear.select("k1", "k2", "first").union(exact.filter(F.col("count") >= min_sites).drop("count"))


@F.pandas_udf(StringType())
def _without(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, removed in texts:
        kept = []
        for t, gone in zip(text, removed):
            if t is None:
                kept.append(None)
                continue
            gone = set(gone.tolist())
            kept.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone))
        yield pd.Series(kept, dtype=object)


def without_boilerplate(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    site: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    lines_column: str = "__lines",
    removed_column: str = "__removed",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and two more columns.

    A line (blanks at its ends aside) that stands on ``min_sites`` or more distinct sites is
    removed from all documents but the one with the smallest id that has it, so no text
    disappears from the corpus. ``lines_column`` counts a text's lines that aren't blank,
    ``removed_column`` those taken out (columns of these names are replaced); the other lines keep their order and spelling.

    Null texts stay null with no lines, empty ones empty. A null site is no site. A document
    without id keeps its text, though its lines count. Rows that repeat an id are treated
    alike. Other columns pass through, whatever their names; an empty table stays empty. A very
    long text is one row of the join; its lines count like any others.
    """
    lines = staged(_lines(docs, text, id, site))
    boilerplate = broadcast_if_small(spread_lines(lines, min_sites, lg_k))
    hits = lines.join(boilerplate, ["k1", "k2"]).filter("id <> first")
    id_, gone_, text_ = (fresh(docs, name) for name in ("__id", "__gone", "__text"))
    by_document = hits.groupBy(F.col("id").alias(id_)).agg(F.collect_set("pos").alias(gone_))
    # Always by shuffle on the id: the texts move once, at every size.
    by_document = by_document.hint("merge")
    joined = docs.join(by_document, docs[id] == by_document[id_], "left")
    gone = F.col(gone_).isNotNull()
    cleaned = F.when(gone, _without(F.when(gone, joined[text]), F.col(gone_))).otherwise(joined[text])
    count = F.expr(f"size(filter(split({text_}, '\\n'), x -> btrim(x, ' \\t\\r\\f\\u000b') <> ''))")
    out = joined.withColumn(text_, joined[text]).withColumn(text, cleaned)
    return (
        out.withColumn(lines_column, F.when(F.col(text_).isNull(), 0).otherwise(count).cast("bigint"))
        .withColumn(removed_column, F.when(gone, F.size(gone_)).otherwise(0).cast("bigint"))
        .drop(text_, id_, gone_)
    )
