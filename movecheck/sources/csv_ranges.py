"""One CSV file read by many tasks although quoted texts may hold line breaks.

A first pass finds out, for each byte range that Spark cuts a file into, whether a quoted text is
open at its end if one is, or is not, open at its start. Running over a file's ranges in order, that
tells every range how it starts; the second pass cuts ranges into records and joins the few
records that lie across ranges. Lines stay in the task that reads them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movecheck.session import checkpointed

#: How CSV texts are written here: doubled quotes inside quotes, line breaks inside quotes.
DIALECT = {"quote": '"', "escape": '"', "multiLine": "true"}

#: Ranges that may open inside a quoted text; their list is broadcast, about 150 bytes each.
MAX_RANGES = 1_000_000

_CLOSED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted text is open after a line, given whether one was open before it.

    A quote opens a text only as the first character of a field; elsewhere it is an ordinary one.
    """
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"') + 1
            if not at:
                return False
        at += 1
    while closed := _CLOSED.match(line, at):
        at = line.find(',"', closed.end()) + 2
        if at == 1:
            return False
    return True


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of one range each, with its columns but for the line. A range's rows come in a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) for i in range(1, batch.num_columns)]
        first, last = (tuple(k[i].as_py() for k in keys) for i in (0, -1))
        if first == last:
            yield first, batch
            continue
        at = 0
        for key, rows in groupby(zip(*[k.to_pylist() for k in keys])):
            size = sum(1 for _ in rows)
            yield key, batch.slice(at, size)
            at += size


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a text is open at a range's end if none was at its start, and if one was.

    ``crlf`` says that the range's first line ends with a carriage return.
    """

    def row() -> pa.RecordBatch:
        path, start = key
        return pa.RecordBatch.from_pylist(
            [{"path": path, "start": start, "closed": closed, "opened": opened, "crlf": crlf}]
        )

    key = None
    closed, opened, crlf = False, True, False
    for now, rows in _by_range(batches):
        if now != key:
            if key is not None:
                yield row()
            key, closed, opened = now, False, True
            crlf = rows.column(0)[0].as_py().endswith("\r")
        lines = rows.column(0)
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            same = closed == opened
            closed = open_after(line, closed)
            opened = closed if same else open_after(line, opened)
    if key is not None:
        yield row()


_PIECE = "path string, start bigint, record string, begins boolean, ends boolean, leads boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of every range, in order; ``leads`` marks a file's first record."""

    def made(records: list[str], begins: list[bool], ends: list[bool]) -> pa.RecordBatch:
        nonlocal led
        leads = [False] * len(records)
        if not led:
            leader = next((i for i, (r, b) in enumerate(zip(records, begins)) if b and r.removeprefix("\ufeff")), None)
            if leader is not None:
                leads[leader], led = True, True
        n = len(records)
        columns = [[key[0]] * n, [key[1]] * n, records, begins, ends, leads]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        names = [field.split()[0] for field in _PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    key, led, inside, crlf, begun = None, True, False, False, True
    pending: list[str] = []
    for now, rows in _by_range(batches):
        if now != key:
            if pending:
                yield made(["\n".join(pending)], [begun], [False])
            key, pending = now, []
            led, inside, crlf = now[1] != 0, now[2], now[3]
            begun = not inside
        records, begins = [], []
        column = rows.column(0)
        lines = column.to_pylist()
        if crlf:
            lines = [line.removesuffix("\r") for line in lines]
        at = 0
        # Lines without a quote change nothing, so they go in runs.
        for quoted in [*pc.indices_nonzero(pc.match_substring(column, '"')).to_pylist(), len(lines)]:
            run, at = lines[at:quoted], quoted + 1
            if inside:
                pending += run
            elif run:
                records += run
                begins += [begun] + [True] * (len(run) - 1)
                begun = True
            if quoted == len(lines):
                break
            line = lines[quoted]
            inside = open_after(line, inside)
            if inside:
                pending.append(line)
                continue
            records.append("\n".join([*pending, line]))
            begins.append(begun)
            pending, begun = [], True
        yield made(records, begins, [True] * len(records))
    if pending:
        yield made(["\n".join(pending)], [begun], [False])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )


def range_starts(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, inside, crlf): whether each byte range of the files begins inside a quoted text.

    ``crlf`` says that lines of the file end with a carriage return and a line feed: its first does.

    A range either fixes how it ends, or keeps what it began with, or turns it round; the last
    one that fixed it and the turns since then give the answer. The window holds a row per range.
    """
    ends = _lines(spark, path).mapInArrow(_ends, "path string, start bigint, closed boolean, opened boolean, crlf boolean")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum("turns").over(before), F.lit(0))
    # Turns are counted from the file's start; a range that fixes its end leaves out those before it.
    fixed = F.when(F.col("closed") == F.col("opened"), F.col("closed").cast("int"))
    counted = ends.withColumn("turns", (F.col("closed") & ~F.col("opened")).cast("int"))
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    marked = counted.withColumn("fixed", fixed + F.sum("turns").over(upto))
    last = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0))
    inside = ((last + turns) % 2 == 1).alias("inside")
    return marked.select("path", "start", inside, F.first("crlf").over(upto).alias("crlf"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, leads): every record's text, of a file or a folder of part files.

    ``leads`` marks the first record of a file that isn't empty. Lines end with a line feed, or
    with a carriage return and a line feed if a file's first line does, in quoted texts too (they get the
    line feed alone then, as from Spark's reader). Empty lines are no records; texts are UTF-8; a
    quoted text that is never closed reaches to the end of its file. Only parts of records that lie across ranges are
    shuffled, two per range at most. An action: the first pass runs here, and the list
    of ranges is broadcast (more than ``MAX_RANGES`` are an error: raise
    ``spark.sql.files.maxPartitionBytes``). Should Spark cut the files otherwise in the second pass, the
    query fails rather than misread them.
    """
    starts = checkpointed(range_starts(spark, path))
    count = starts.count()
    if count > MAX_RANGES:
        raise ValueError(f"{count} ranges in {path}: raise spark.sql.files.maxPartitionBytes")
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("files were cut otherwise in the second pass")))
    lines = _lines(spark, path).join(F.broadcast(starts), ["path", "start"], "left")
    lines = lines.select("value", "path", "start", known.otherwise(F.col("inside")).alias("inside"), "crlf")
    pieces = lines.mapInArrow(_pieces, _PIECE)
    whole = F.col("begins") & F.col("ends")
    order = Window.partitionBy("path").orderBy("start", "begins")
    parts = pieces.filter(~whole).withColumn("number", F.sum(F.col("begins").cast("int")).over(order))
    in_order = F.array_sort(F.collect_list(F.struct("start", "begins", "record")))
    joined = parts.groupBy("path", "number").agg(
        F.array_join(F.transform(in_order, lambda p: p["record"]), "\n").alias("record"),
        F.max("leads").alias("leads"),
    )
    columns = ["path", "record", "leads"]
    records = pieces.filter(whole).select(*columns).union(joined.select(*columns))
    without_mark = F.regexp_replace("record", "^\ufeff", "")
    record = F.when(F.col("leads"), without_mark).otherwise(F.col("record"))
    return records.withColumn("record", record).filter(F.col("record") != "")


def read_split(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header in every file, each file read by as many tasks as it has ranges.

    Gives what Spark's own reader gives with ``header``, ``multiLine`` and, without ``schema``,
    ``inferSchema``; rows have no order. Reads the files twice, three times to infer types.
    """
    records = csv_records(spark, path)
    rows = records.filter(~F.col("leads")).select("record")
    if schema is None:
        names = spark.read.options(header=True, **DIALECT).csv(path).columns
        heading = ",".join('"' + name.replace('"', '""') + '"' for name in names)
        sample = spark.createDataFrame([(heading,)], "record string").union(rows)
        reader = spark.read.options(header=True, inferSchema=True, **DIALECT)
        # Spark's reader takes a Dataset of records too; its Python form would go through an RDD.
        texts = getattr(sample._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(reader._jreader.csv(texts), spark).schema
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("record", ddl, DIALECT).alias("row")).select("row.*")


def longest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the longest file of a table; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
