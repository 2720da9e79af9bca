"""Registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

import hashlib

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.llm import (
    byte_bpe,
    chat,
    embed_dedup,
    license_scan,
    line_dedup,
    mixing,
    periodic_runs,
    phrase_mining,
    simhash,
    token_counts,
    topk,
    toxicity,
    warc,
)
from movecheck.llm.common import broadcast_if_small, staged
from movecheck.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKEN_LIMIT = 2048
#: Target weights of language and quality; a domain's weight is their product.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}
QUALITY_WEIGHTS = {1: 0.9, 0: 0.1}
TARGETS = {f"{lang}-{q}": w * v for lang, w in LANGUAGE_WEIGHTS.items() for q, v in QUALITY_WEIGHTS.items()}


def query(sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _canonical_sql(text: str) -> str:
    """The canonical form of a text in SQL: copyright lines, case, punctuation, spellings."""
    dropped = license_scan._COPYRIGHT.pattern.replace("'", "''")
    lower = f"regexp_replace(lower({text}), '(?m){dropped}', '', 'g')"
    words = f"' ' || array_to_string(regexp_extract_all({lower}, '[\\p{{L}}\\p{{N}}]+'), '  ') || ' '"
    for other, kept in license_scan.SPELLINGS.items():
        words = f"replace({words}, ' {other} ', ' {kept} ')"
    return f"replace(trim({words}), '  ', ' ')"


def _license_sql() -> str:
    known = ", ".join(f"('{name}', '{license_scan.digest(text)}')" for name, text in sorted(license_scan.LICENSES.items()))
    return f"""
WITH known(license_id, digest) AS (VALUES {known}),
hashed AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents)
SELECT doc_id, hashed.digest AS digest, license_id
FROM hashed LEFT JOIN (SELECT digest, min(license_id) AS license_id FROM known GROUP BY digest) k
  ON hashed.digest = k.digest"""


@query(_license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "digest", "license_id")


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of labelled documents with their domain: language and quality."""
    graded = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(broadcast_if_small(graded), "doc_id").select(
        "text", F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("domain")
    )


@query()
def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


@query()
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


_DISTANCE = " + ".join(f"CAST((q.embedding[{j}] > 0) <> (b.embedding[{j}] > 0) AS BIGINT)" for j in range(1, topk.BITS + 1))


@query(f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, {_DISTANCE} AS distance
  FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= {topk.K}""")
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.sign_codes(table(spark, sf_dir, "embeddings"))
    return topk.search(codes.filter("id % 100 = 0"), codes)


@query()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.digests(docs, BYTE_BPE, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: The conversation that the query adds: texts made of the template's control strings.
CONTROL_CONVERSATION = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


@query()
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    said = table(spark, sf_dir, "conversations").select(*columns)
    extra = spark.createDataFrame(CONTROL_CONVERSATION, said.schema)
    return read_back(chat.formatted(said.unionByName(extra)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from formatted text and spans alone."""

    def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for conv, text, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                said = [chat.read_turn(text[t["start"] : t["end"]]) for t in turns]
                whole = "".join(f"{role}\n{content}\n" for role, content in said)
                loss = "".join(chat.unescape(text[t["text_start"] : t["text_end"]]) for t in turns if t["loss"])
                out.append(
                    {
                        "conv_id": conv,
                        "n_turns": len(said),
                        "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(text),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    kinds = ["n_turns bigint", "turns_sha256 string", "loss_chars bigint", "loss_sha256 string", "formatted_chars bigint"]
    arrow = pa.schema(
        [("conv_id", pa.int64())] + [(k.split()[0], pa.int64() if "bigint" in k else pa.string()) for k in kinds]
    )
    ready = formatted.select(F.col("conv_id").cast("bigint"), "formatted", "turns")
    return ready.mapInArrow(digest_batches, ", ".join(["conv_id bigint", *kinds]))


_BLANK = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"


@query(f"""
WITH cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
lines AS (SELECT *, trim(line, {_BLANK}) AS k FROM cut),
spread AS (SELECT k, min(doc_id) AS first FROM lines WHERE k <> ''
           GROUP BY k HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (SELECT lines.*, coalesce(doc_id <> spread.first, false) AS gone FROM lines LEFT JOIN spread ON lines.k = spread.k),
kept AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, md5(text) AS kept_md5 FROM kept""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.without_boilerplate(docs).select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.length("text").cast("bigint").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )




@query(f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
spans AS (SELECT lang, w, i, unnest([1, 2, 3]) AS k FROM placed),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM spans WHERE i + k - 1 <= len(w) GROUP BY ALL),
size AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {phrase_mining.MIN_COUNT}),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM often),
met AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r,
         (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[b:b + 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest([1, 2]) AS b FROM often WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < {phrase_mining.CONTAINED} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN size USING (lang) WHERE rank <= 2000""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): in texts whose id's checksum ends in 0, words from some word on
    repeat the first of them; the checksum says where and how many."""
    ws = F.translate("text", "\t\n\x0b\f\r", "     ")
    words = F.filter(F.split(ws, " "), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("h")).select("*", F.when(F.col("h") % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice("w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return cut.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), planted).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")

    def longer(best, run):
        more = best["length"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", none, longer)
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_BASE32 = " || ".join(f"to_base(('0x' || substr(hashed.sha, {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4))


@query(f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT sha, min(page_id) AS first FROM hashed WHERE payload_bytes >= {warc.MIN_REVISIT_BYTES} GROUP BY sha)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       translate(upper({_BASE32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM hashed LEFT JOIN firsts ON hashed.sha = firsts.sha""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_folder(spark)
    warc.write_archives(pages, path)
    found = warc.captures(spark, path)
    noted = F.decode(F.get("metadata.payload", F.lit(0)), "UTF-8")
    read = staged(
        found.select(
            F.regexp_extract(noted, "page-id: (-?[0-9]*)", 1).try_cast(pages.schema["page_id"].dataType).alias("page_id"),
            "record_id",
            "refers_to",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            warc.base32_sha1(F.col("payload")).alias("payload_digest"),
            F.col("type").alias("record_type"),
        )
    )
    # A revisit has no payload of its own: length and digest are those of the response it names.
    whole = read.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")
    )
    again = F.col("record_type") == "revisit"
    return read.join(whole, "refers_to", "left").select(
        "page_id",
        F.when(again, F.col("n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("first").alias("refers_to"),
    )
