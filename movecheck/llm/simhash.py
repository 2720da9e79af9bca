"""SimHash near-duplicates over pivot distance tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from movecheck.llm.common import broadcast_if_small, components, fresh, grouped, in_blocks, released, runs, spanning_edges, staged, vacate

SHINGLE = 3
MAX_BITS = 3
#: Words of a text that are hashed at a time, so that a very long text needs no more memory.
CHUNK_WORDS = 65_536
#: Fingerprints of a bucket that are compared in one piece.
BLOCK = 1_500
_WORD = re.compile(rb"[^ \t-\r]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 if it is null or has no words."""
    words = (m[0] for m in _WORD.finditer((text or "").encode("utf-8", "surrogatepass").lower()))
    bits = np.zeros(64, dtype=np.int64)
    total, kept = 0, []
    while chunk := list(islice(words, CHUNK_WORDS)):
        chunk = kept + chunk
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*[chunk[i:] for i in range(shingle)])]
        if hashes:
            octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
            bits += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        kept = chunk[len(hashes) :] if hashes else chunk
    if not total and kept:
        return xxhash.xxh64_intdigest(b" ".join(kept), 42)
    return int.from_bytes(np.packbits(2 * bits > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp) with the fingerprint as a signed long; one row per row of ``docs``."""

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])
        released()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(hash_batches, f"id {kind}, fp bigint")


class PivotTable:
    """Hamming distances of fingerprints to reference fingerprints.

    One reference is a base; the others differ from it inside one of ``max_bits`` + 2
    segments only, in ``per_segment`` patterns. Two facts make the table useful:

    * A coordinate changes by at most one for each bit that differs, so a pair with a
      coordinate difference above ``max_bits`` anywhere is no link (triangle inequality).
    * The differences between a segment's coordinates and the base coordinate depend on the
      bits of that segment alone. Of ``max_bits`` + 2 segments at least two are equal in
      a link, hence so are the coordinate differences of these two: they are join keys, and
      the tables of all pairs of segments together lose no link.
    """

    def __init__(self, max_bits: int = MAX_BITS, per_segment: int = 10, seed: int = 20) -> None:
        draw = np.random.default_rng(seed)
        self.max_bits, self.per_segment = max_bits, per_segment
        self.segments = max_bits + 2
        cuts = np.linspace(0, 64, self.segments + 1).astype(int)
        base = draw.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        references = [base]
        for low, high in zip(cuts, cuts[1:]):
            inside = np.uint64(((1 << int(high)) - 1) ^ ((1 << int(low)) - 1))
            for _ in range(per_segment):
                while True:
                    reference = base ^ (draw.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(draw.integers(2)) & inside)
                    if reference not in references:
                        break
                references.append(reference)
        self.references = np.array(references, dtype=np.uint64)
        self.tables = list(combinations(range(self.segments), 2))

    def coordinates(self, fps: np.ndarray) -> np.ndarray:
        """Distances (rows) x (references) as int8."""
        return np.bitwise_count(fps.view(np.uint64)[:, None] ^ self.references[None, :]).astype(np.int8)

    def keys(self, fps: np.ndarray) -> list[np.ndarray]:
        """For each pair of segments the key of every fingerprint, as longs."""
        at = self.coordinates(fps).astype(np.int64)
        within = (at[:, 1:] - at[:, :1]).reshape(len(fps), self.segments, self.per_segment)
        mixed = np.zeros((len(fps), self.segments), dtype=np.uint64)
        for j in range(self.per_segment):
            mixed = mixed * np.uint64(64) + (within[:, :, j] + 32).astype(np.uint64)
        with np.errstate(over="ignore"):
            return [(mixed[:, a] * np.uint64(0x9E3779B97F4A7C15) + mixed[:, b]).view(np.int64) for a, b in self.tables]

    def links(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Boolean matrix of links: coordinates first, then the bits of what is left."""
        kept = np.ones((len(left), len(right)), dtype=bool)
        a, b = self.coordinates(left), self.coordinates(right)
        for r in range(len(self.references)):
            kept &= np.abs(a[:, None, r] - b[None, :, r]) <= self.max_bits
        i, j = np.nonzero(kept)
        differing = np.bitwise_count(left.view(np.uint64)[i] ^ right.view(np.uint64)[j])
        kept[i, j] = differing <= self.max_bits
        return kept


_RUN = ["t", "key", "lo", "hi"]


def fingerprint_links(distinct: DataFrame, pivots: PivotTable, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect whatever ``pivots.max_bits`` connects, from distinct ``fp``.

    Every bucket of the pivot tables is searched whole, in blocks; of a dense bucket a
    spanning forest is returned, not all its pairs.
    """

    def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for t, key in enumerate(pivots.keys(fps)):
                columns = [pa.array(np.full(len(fps), t, dtype=np.int32)), pa.array(key), pa.array(fps)]
                yield pa.RecordBatch.from_arrays(columns, ["t", "key", "fp"])

    def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, _RUN):
            fps, part = table.column("fp").to_numpy(), table.column("part").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            found: list[tuple[int, int]] = []
            for start, end in zip(starts, starts[1:]):
                own = fps[start:end]
                if lo[start] == hi[start]:
                    linked = pivots.links(own, own)
                    np.fill_diagonal(linked, False)
                else:
                    linked = np.zeros((len(own), len(own)), dtype=bool)
                    left, right = (np.flatnonzero(part[start:end] == side[start]) for side in (lo, hi))
                    across = pivots.links(own[left], own[right])
                    linked[np.ix_(left, right)] = across
                    linked[np.ix_(right, left)] = across.T
                found += [(int(own[i]), int(own[j])) for i, j in spanning_edges(linked)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = distinct.select("fp").mapInArrow(key_batches, "t int, key bigint, fp bigint")
    dealt = in_blocks(rows, ["t", "key"], "fp", block)
    return grouped(dealt, _RUN).mapInArrow(link_batches, "a bigint, b bigint")


def _placed(docs: DataFrame, text: str, id: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp) of ``docs``, staged, and rows (fp, root, component_id) of its fingerprints.

    ``root`` names the component, ``component_id`` is its smallest id; with repeated ids two
    components may have the same.
    """
    fps = staged(fingerprints(docs, text, id, shingle))
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(fingerprint_links(nodes, PivotTable(max_bits)))
    linked = staged(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    firsts = linked.filter("root is not null").groupBy("root").agg(F.min("first").alias("component"))
    # A root may hold a third of the fingerprints: they stay where they are while the roots are few.
    joined = linked.join(broadcast_if_small(firsts), "root", "left")
    return fps, joined.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component_id"))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Rows (id, fingerprint, component_id) of every row of ``docs``.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; the words'
    ``shingle``-grams, repeats included, are hashed by XXH64 (seed 42). Documents whose
    fingerprints differ in at most ``max_bits`` bits are linked; ``component_id`` is the
    smallest id reachable by links, its own included.

    Null and empty texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so a group of copies costs as much as one text. A null id
    counts for nothing: its component is the smallest id that is not null, or null. Repeated
    rows are all returned; other columns are ignored; an empty table gives no rows.
    """
    fps, placed = _placed(docs, text, id, shingle, max_bits)
    return fps.join(placed, "fp").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@F.pandas_udf(LongType())
def _fingerprint_of(texts: pd.Series, shingle: pd.Series) -> pd.Series:
    found = np.array([fingerprint(t, int(n)) for t, n in zip(texts, shingle)], dtype=np.uint64)
    return pd.Series(found.view(np.int64))


def deduplicated(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with one row of each component: that with its smallest id.

    A row whose id others repeat is told apart by its fingerprint, so each component keeps a
    row whatever its id is shared with; of rows that have its smallest id the one with the
    smallest fingerprint stays, of equals any one. Rows without an id stay (they can't be told
    apart). Columns may have any names; an empty table stays empty.

    What is decided is decided on ids and fingerprints. The texts aren't sorted, and stay where
    they are while few ids go; else they move once, in an anti join on the ids.
    """
    fps, placed = _placed(docs, text, id, shingle, max_bits)
    found = staged(fps.filter("id is not null").join(placed, "fp"))
    rows = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component"))
    rows = staged(rows.select("id", (F.col("n") > 1).alias("many"), (F.col("id") == F.col("component")).alias("first")))
    id_, fp_ = fresh(docs, "id"), fresh(docs, "fp")
    moved = broadcast_if_small(rows.filter("many or not first").select(F.col("id").alias(id_)))
    stays = docs.join(moved, docs[id] == moved[id_], "left_anti")
    # Rows of repeated ids: of each component one row of its smallest (id, fingerprint).
    many = broadcast_if_small(rows.filter("many").select(F.col("id").alias(id_)))
    repeated = docs.join(many, docs[id] == many[id_], "left_semi").withColumn(fp_, _fingerprint_of(text, F.lit(shingle)))
    least = found.filter("id = component_id").groupBy("root").agg(F.min("id").alias("id"), F.min("fp").alias("fp"))
    wanted = least.join(rows.filter("many"), "id", "left_semi")
    wanted = broadcast_if_small(wanted.select(F.col("id").alias(id_), F.col("fp").alias(fresh(repeated, "wanted"))).distinct())
    same = (repeated[id] == wanted[id_]) & (repeated[fp_] == wanted[wanted.columns[1]])
    kept = repeated.join(wanted, same, "left_semi").dropDuplicates([id, fp_]).drop(fp_)
    return stays.unionByName(kept)
