"""WARC archives: written through Spark's own text writer, read record by record, and
assembled to captures by joining what records say of each other."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movecheck.llm.common import broadcast_if_small, discard, staged

#: Payload bytes of one archive, about; one archive is read by one task.
ARCHIVE_BYTES = 64 * 1024 * 1024
#: Payloads of fewer bytes are never replaced by a reference to an equal one.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
#: Bytes of payload after which a task hands on the records it has read.
BATCH_BYTES = 8 * 1024 * 1024
_LINE = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, 32 letters and digits."""
    found = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(found, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid_of(*parts: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat(*parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends behind it, which the writer puts there; null fields are left out."""
    length = ("Content-Length", F.octet_length(block).cast("string"))
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_LINE))) for name, value in [*fields, length]]
    return F.concat(F.lit(f"WARC/1.1{_LINE}"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(_LINE), block)


def write_archives(
    pages: DataFrame,
    path: str,
    payload: str = "html",
    id: str = "page_id",
    url: str = "url",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a request, a response or revisit, and a metadata record for every row (an action).

    Of equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is a
    response in full; the others are revisit records that refer to it. The request and the
    metadata record, which holds the id, name the response in ``WARC-Concurrent-To``.

    Archives are gzip files of about ``archive_bytes`` of payload, written by Spark's text
    writer: a record is a line that ends in two line ends, so a lost executor leaves no half
    archive. A null payload is empty, a null URL has no field, line ends in a URL are
    percent-encoded. A null id comes last among equal payloads; of repeated rows one is the response.
    An empty table leaves no records. The rows are staged once, because the random record
    ids must not change between the choice of responses and the writing.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    said = F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id).cast("string").alias("page"), F.col(id).alias("order"), said.alias("url"), body.alias("body"))
    rows = staged(
        rows.withColumns({"record": F.expr("uuid()"), "digest": base32_sha1(F.col("body").cast("binary")), "size": F.octet_length("body")})
    )
    # The narrow columns decide; of each payload that stands more than once the first row is kept.
    firsts = (
        rows.filter(F.col("size") >= min_revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.min(F.struct(F.col("order").isNull().alias("none"), "order", "record")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "size", F.col("first.record").alias("refers"))
    )
    whole, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    # Payloads stay where they are while few of them repeat.
    decided = rows.join(broadcast_if_small(firsts), ["digest", "size"], "left").withColumn("again", F.col("refers") != F.col("record"))
    decided = decided.withColumn("again", F.coalesce("again", F.lit(False)))

    def name(record: Column) -> Column:
        return F.concat(F.lit("<urn:uuid:"), record, F.lit(">"))

    def fields(kind: Column, record: Column, content: str, *more: tuple[str, Column]) -> list[tuple[str, Column]]:
        first = [("WARC-Type", kind), ("WARC-Record-ID", name(record)), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
        return [*first, *more, ("Content-Type", F.lit(content))]

    record, again = F.col("record"), F.col("again")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(_LINE + _LINE),
    )
    capture = _record(
        fields(
            F.when(again, "revisit").otherwise("response"),
            record,
            "application/http; msgtype=response",
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, PROFILE)),
            ("WARC-Refers-To", F.when(again, name(F.col("refers")))),
        ),
        F.concat(head, F.when(again, "").otherwise(F.col("body"))),
    )
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)
    place = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit(f" HTTP/1.1{_LINE}Host: "), host, F.lit(_LINE + _LINE))
    with_capture = ("WARC-Concurrent-To", name(record))
    request = _record(fields(F.lit("request"), _uuid_of(record, F.lit("request")), "application/http; msgtype=request", with_capture), get)
    noted = F.concat(F.lit("page-id: "), F.coalesce("page", F.lit("")), F.lit(_LINE))
    metadata = _record(fields(F.lit("metadata"), _uuid_of(record, F.lit("metadata")), "application/warc-fields", with_capture), noted)
    lines = decided.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    per_file = max(3, int(3 * n * archive_bytes / max(whole or 0, 1)))
    lines.write.option("lineSep", _LINE + _LINE).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    discard(rows)


def _parsed(file) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Fields (by lower-case name) and block of each record of an open archive."""
    while line := file.readline():
        if not line.strip():
            continue  # line ends between records
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        fields: dict[str, list[str]] = {}
        last = None
        while (line := file.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:
                fields[last][-1] += " " + text.strip()
                continue
            last, _, value = text.partition(":")
            last = last.strip().lower()
            fields.setdefault(last, []).append(value.strip())
        length = int(fields["content-length"][0])
        block = file.read(length)
        if len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} ends after {len(block)} of {length} bytes")
        yield fields, block


_RECORD = "record_id string, type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, concurrent_to array<string>, http_head string, payload binary"


def records(spark: SparkSession, path: str, capture_payloads: bool = True) -> DataFrame:
    """Rows of all records of the archives under ``path``, plain or gzip, whoever wrote them.

    Columns: record_id, type, target_uri, date, content_type, payload_digest, refers_to,
    concurrent_to (array), http_head and payload. Blocks are cut by their stated length; of HTTP
    messages the head is apart and the payload is what follows it, else it is the block. Without
    ``capture_payloads`` the payload of captures is null. A missing field is null; an archive that
    breaks off or isn't one fails with its name. An archive is one row of Spark's binary source, so it
    must be below 2 GB.
    """
    kinds = [c.rsplit(" ", 1) for c in _RECORD.split(", ")]
    to_arrow = {"string": pa.string(), "binary": pa.large_binary(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(name, to_arrow[kind] if kind != "binary" else pa.binary()) for name, kind in kinds])

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                file = io.BufferedReader(pa.BufferReader(batch.column(1)[i].as_buffer()))
                if file.peek(2)[:2] == b"\x1f\x8b":
                    file = gzip.GzipFile(fileobj=file)
                try:
                    for fields, block in _parsed(file):
                        first = {name: values[0] for name, values in fields.items()}
                        kind = first.get("warc-type")
                        head = None
                        if first.get("content-type", "").startswith("application/http"):
                            head, _, block = block.partition(b"\r\n\r\n")
                            head = head.decode("utf-8", "replace")
                        if kind in CAPTURES and not capture_payloads:
                            block = None
                        held += len(block or b"") + 500
                        out.append(
                            {
                                "record_id": first.get("warc-record-id"),
                                "type": kind,
                                "target_uri": first.get("warc-target-uri"),
                                "date": first.get("warc-date"),
                                "content_type": first.get("content-type"),
                                "payload_digest": first.get("warc-payload-digest"),
                                "refers_to": first.get("warc-refers-to"),
                                "concurrent_to": fields.get("warc-concurrent-to", []),
                                "http_head": head,
                                "payload": block,
                            }
                        )
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out, held = [], 0
                except (ValueError, KeyError, EOFError, OSError) as error:
                    raise ValueError(f"{batch.column(0)[i].as_py()}: {error}") from error
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.filter("length > 0").select("path", "content").mapInArrow(read_batches, _RECORD)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per response, revisit and resource record of the archives under ``path``.

    Columns: those of ``records`` without concurrent_to, and ``requests`` and ``metadata``, arrays
    of (record_id, http_head, payload) by record id. A request or metadata record belongs to each
    capture that it names in ``WARC-Concurrent-To``, and to each that names it; one without a
    capture is in ``records`` only. A capture without any has empty arrays; no archives, no rows.
    Records that share an id each get a row.

    The payloads of captures move once, in the last join; links and small records are joined
    without them, from a staged copy (an action). All small records of a capture meet in its row.
    """
    heads = staged(records(spark, path, capture_payloads=False))
    is_capture = F.col("type").isin(*CAPTURES)
    small = F.struct("record_id", "http_head", "payload").alias("small")
    others = heads.filter(F.col("type").isin("request", "metadata")).select("type", "concurrent_to", small)
    named = others.select(F.explode("concurrent_to").alias("capture"), "type", "small")
    naming = heads.filter(is_capture & (F.size("concurrent_to") > 0)).select(
        F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other")
    )
    met = naming.join(others, naming["other"] == others["small.record_id"]).select("capture", "type", "small")
    grouped = named.unionByName(met).groupBy("capture").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("small")))).alias(n) for t, n in (("request", "requests"), ("metadata", "metadata"))]
    )
    wide = records(spark, path).filter(is_capture).drop("concurrent_to")
    none = F.array().cast("array<struct<record_id:string,http_head:string,payload:binary>>")
    joined = wide.join(grouped, wide["record_id"] == grouped["capture"], "left").drop("capture")
    return joined.withColumns({n: F.coalesce(n, none) for n in ("requests", "metadata")})
