"""Helpers of the corpus operators: staging, buckets split into blocks, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movecheck.session import scratch_folder


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read from there.

    An action. The files outlive any executor and are what later stages reread, so a lost
    executor never repeats the work above, and rows cannot change between two reads.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing will read again; None is skipped."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        # The folder that was read, of a table as `staged` returned it.
        relation = table._jdf.queryExecution().analyzed().relation()
        for folder in [str(p) for p in relation.location().rootPaths().mkString("\n").split("\n")]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept in this worker from task to task until another thing is asked for.

    A worker serves one operator after another, so it keeps the latest thing alone.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def vacate() -> None:
    """Forget what an earlier operator left in this worker: called where a task keeps nothing itself."""
    if _resident:
        _resident.clear()
        released()


def released() -> None:
    """Give memory that a worker no longer uses back to the machine.

    Workers serve one operator after another; what Arrow and the allocator keep for later adds up.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or what it takes for ``df`` not to have it: columns may be called anything."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_blocks(rows: DataFrame, keys: Sequence[str], member: str, block: int) -> DataFrame:
    """Rows of every bucket with two members or more, dealt to the bucket's block pairs.

    A bucket (equal ``keys``) of n rows is cut by a hash of ``member`` into k = ceil(n /
    ``block``) parts, and each pair of parts becomes a group of its own: columns ``lo`` and
    ``hi`` name the pair, ``part`` the row's own part. Each two rows meet in exactly one
    group, no group has much more than two blocks of rows, and nothing is left out.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block)
    dealt = rows.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64(member), parts))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    return (
        dealt.withColumn("other", other)
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("n", "other")
    )


def grouped(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a group in one partition, one after the other.

    The number of partitions is given: adaptive execution would merge them by their bytes,
    and here the work is in comparing rows, which are few bytes each.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of sorted rows, with the offsets at which groups begin.

    The last group of a batch waits for the next batch, so groups are never torn.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        changed = np.zeros(len(table), dtype=bool)
        changed[:1] = True
        for key in keys:
            values = table.column(key).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(changed)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = cut(table)
        if len(starts) > 1:
            last = int(starts[-1])
            yield table.slice(0, last), starts
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        starts = cut(table)
        yield table, np.append(starts, len(table))


def spanning_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix: what connects, not all pairs."""
    n = len(linked)
    unseen = linked.any(axis=1)
    edges = []
    while unseen.any():
        frontier = [int(np.argmax(unseen))]
        unseen[frontier[0]] = False
        while frontier:
            node = frontier.pop()
            found = np.flatnonzero(linked[node] & unseen)
            unseen[found] = False
            edges += [(node, int(x)) for x in found]
            frontier += found.tolist()
        if len(edges) >= n:
            break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node.

    Alternates large stars and small stars: every round ties the neighbours of a node to
    their smallest one, so the number of rounds grows with the logarithm of the longest path,
    and the edges never outnumber the first ones. Each round is staged; only a count and a
    checksum come to the driver. A hub's edges are folded to one minimum before they move
    and joined back under skew handling. Nulls and loops are ignored; no edges, no rows.
    """
    edges = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(least).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def broadcast_if_small(df: DataFrame, rows: int = 200_000, items: str | None = None) -> DataFrame:
    """``df`` staged, with a broadcast hint if it proves to hold few rows (an action).

    For rows of fixed width; ``items`` names an array column whose elements count as rows.
    Beyond the limit the planner joins by shuffle, which it splits where a key is hot.
    """
    written = staged(df)
    count = F.sum(F.size(items) + 1) if items else F.count(F.lit(1))
    return F.broadcast(written) if (written.agg(count).first()[0] or 0) <= rows else written
