"""From raw documents to token ids: five stages, each a corpus operator over all that is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from movecheck.llm.common import discard, fresh, staged
from movecheck.llm.queries import BYTE_BPE, TARGETS, labelled_domains, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the classifier learns from their labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; those of which nothing is left go."""
    lines, removed = fresh(docs, "__lines"), fresh(docs, "__removed")
    cleaned = line_dedup.without_boilerplate(docs, lines_column=lines, removed_column=removed)
    emptied = (F.col(removed) > 0) & (F.col(removed) == F.col(lines))
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    n_chars = F.when(F.col(removed) > 0, count).otherwise(F.col("n_chars"))
    return cleaned.filter(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.deduplicated(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask, each at least once."""
    rated = mixing.rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)
    return mixing.repeated(docs, rated)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    texts = docs.select("doc_id", "text")
    # The workers have served four stages before; the memo leaves room beside what these keep.
    return byte_bpe.encoded(texts, BYTE_BPE, public_tokenizers.PATTERN, memo=60_000).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("mix_to_targets", mix_to_targets),
    ("byte_bpe", encode),
]

#: No stage but the second can be said in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order from the ``documents`` table, each written as Parquet and reread.

    A stage's table goes when the next one is written.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        discard(written)
        written = docs
    return docs
