"""Embedding near-duplicates: spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movecheck.llm.common import components, grouped, in_blocks, runs, spanning_edges, staged

MIN_COSINE = 0.95
#: Filters that a vector of 32 components or more exceeds on average, in all codes together:
#: each is a chance to meet a near vector. Shorter vectors have more, in proportion.
EXPECTED_FILTERS = 30
#: Independent codes: a vector that lies badly for one rotation lies well for another.
CODES = 3
#: Distinct vectors of a filter that are compared in one piece.
BLOCK = 1_000
SEED = 7


@lru_cache
def cap_threshold(dimension: int, share: float) -> float:
    """The inner product with a fixed unit vector that this share of the sphere exceeds.

    The angle to a fixed vector has the density sin(angle)^(dimension - 2), summed up here on
    a fine grid. Half of the sphere at most.
    """
    if share >= 0.5:
        return 0.0
    edges = np.linspace(0.0, np.pi / 2, 1_000_001)
    density = np.sin((edges[1:] + edges[:-1]) / 2) ** max(0, dimension - 2)
    below = np.concatenate([[0.0], np.cumsum(density)])
    return float(np.cos(np.interp(2 * share * below[-1], below, edges)))


class CapFilters:
    """Filter directions whose caps hold a vector, found without trying them all.

    A direction is the concatenation of two codewords, one for each half of a randomly
    rotated vector: ``codewords`` squared directions from 2 * ``codewords`` short vectors.
    The inner product is the sum of two halves, so a vector's list of all directions above
    the threshold comes from sorting one half's products and cutting it for each codeword of
    the other (list decoding). The threshold leaves ``expected`` directions to a random
    vector; with more vectors there are more and narrower caps, so that a cap holds as many
    as before.
    """

    def __init__(self, dimension: int, n_vectors: int, expected: int = EXPECTED_FILTERS, seed: int = SEED) -> None:
        draw = np.random.default_rng([seed, dimension])
        # In few dimensions more codewords would only repeat each other's caps.
        most = 4 ** max(1, dimension // 2)
        self.codewords = int(min(np.ceil(np.sqrt(max(65_536, 2 * n_vectors))), most))
        self.rotation = np.linalg.qr(draw.standard_normal((dimension, dimension)))[0]
        self.cut = max(1, dimension // 2)
        halves = [draw.standard_normal((self.codewords, max(1, n))) for n in (self.cut, dimension - self.cut)]
        self.halves = [h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves]
        # A direction is two unit vectors side by side, sqrt(2) long.
        self.least = math.sqrt(2) * cap_threshold(dimension, expected / self.codewords**2)

    @classmethod
    def several(cls, dimension: int, n_vectors: int, expected: int) -> list[CapFilters]:
        each = max(1, round(expected * max(1.0, 32 / dimension) / CODES))
        return [cls(dimension, n_vectors, each, SEED + code) for code in range(CODES)]

    def _products(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        right = turned[:, self.cut :] if turned.shape[1] > self.cut else np.zeros((len(unit), 1))
        return turned[:, : self.cut] @ self.halves[0].T, right @ self.halves[1].T

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters it exceeds."""
        left, right = self._products(unit)
        order = np.argsort(-right, axis=1)
        found = []
        for s, r, by in zip(left, np.take_along_axis(-right, order, axis=1), order):
            live = np.flatnonzero(s - r[0] >= self.least)
            upto = np.searchsorted(r, s[live] - self.least, side="right")
            if len(live):
                found.append(np.sort(np.concatenate([i * self.codewords + by[:n] for i, n in zip(live, upto)])))
            else:  # none is exceeded: the closest one
                found.append(np.array([int(np.argmax(s)) * self.codewords + int(by[0])]))
        return found


def _unit(values: pa.Array, dimension: int) -> np.ndarray:
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    matrix = flat.reshape(-1, dimension)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


_RUN = ["dim", "filter", "lo", "hi"]


def near_duplicates(
    vectors: DataFrame,
    vector: str = "embedding",
    id: str = "vec_id",
    min_cosine: float = MIN_COSINE,
    expected: int = EXPECTED_FILTERS,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``.

    Two vectors of one length are linked if their cosine, in double precision, is
    ``min_cosine`` or more. Candidates are vectors that exceed a common filter; every
    candidate pair is verified, so there are no false links. Links at cosine 0.951 in 64
    dimensions were found to 0.99 among 10,000 vectors, 0.98 among 200,000 and 0.96 among 10
    million, at cosine 0.98 to 0.99; a higher ``expected`` costs rows. ``n_links`` counts the other rows linked directly, copies
    included; ``component_id`` is the smallest id reachable, its own included; ``kept`` marks
    the row that has this id.

    Equal vectors are one node with a multiplicity. A pair with several common filters counts
    in the lowest of them only. Crowded filters are compared in blocks which report counts
    and a spanning forest, never their pairs. Vectors that are null, empty, zero, or hold
    null or non-finite components, and rows with a null id, link with nothing: no links, own
    id, kept if there is an id. Repeated ids are rows of their own; other columns are ignored.
    """
    kind = vectors.schema[id].dataType.simpleString()
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    usable = (
        F.col("id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    valid = rows.filter("v is not null")
    nodes = valid.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}

    def filter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CapFilters] = {}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                if dim not in made:
                    made[dim] = CapFilters.several(int(dim), sizes[int(dim)], expected)
                some = batch.filter(pa.array(dims == dim))
                for start in range(0, some.num_rows, 256):
                    part = some.slice(start, 256)
                    unit = _unit(part.column(1), int(dim))
                    each = [c.decode(unit) for c in made[dim]]
                    shift = made[dim][0].codewords ** 2
                    lists = [np.concatenate([k * shift + x for k, x in enumerate(own)]) for own in zip(*each)]
                    at = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                    out = part.take(pa.array(at))
                    every = pa.array([lists[i] for i in at], pa.list_(pa.int64()))
                    columns = [out.column(0), out.column(1), out.column(2), out.column(3), pa.array(np.concatenate(lists)), every]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "v", "copies", "dim", "filter", "filters"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, _RUN):
            node, copies, part = (table.column(c).to_numpy() for c in ("node", "copies", "part"))
            lo, hi, of = (table.column(c).to_numpy() for c in ("lo", "hi", "filter"))
            found: list[tuple[int, int | None, int | None]] = []
            for start, end in zip(starts, starts[1:]):
                start, n = int(start), int(end - start)
                if n < 2:
                    continue
                rows_ = table.slice(start, n)
                unit = _unit(rows_.column("v").combine_chunks(), len(rows_.column("v")[0]))
                linked = unit @ unit.T >= min_cosine
                np.fill_diagonal(linked, False)
                if lo[start] != hi[start]:
                    side = part[start : start + n]
                    linked &= side[:, None] != side[None, :]
                if not linked.any():
                    continue
                linked &= ~_met_before(rows_.column("filters").to_pylist(), int(of[start]))
                counts = linked @ copies[start : start + n]
                found += [(int(node[start + i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
                found += [(int(node[start + i]), int(node[start + j]), None) for i, j in spanning_edges(linked)]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    held = vectors.schema[vector].dataType.simpleString()
    listed = f"node bigint, v {held}, copies bigint, dim int, filter bigint, filters array<bigint>"
    filtered = nodes.select("node", "v", "copies", "dim").mapInArrow(filter_batches, listed)
    dealt = in_blocks(filtered, ["dim", "filter"], "node", BLOCK)
    found = staged(grouped(dealt, _RUN).mapInArrow(verify, "a bigint, b bigint, n bigint"))
    roots = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = nodes.select("node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = staged(placed.join(counts, "node", "left"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component"))
    placed = placed.join(firsts, "root").select("node", "component", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    by_vector = nodes.select("v", "node").join(placed, "node").drop("node")
    own = F.coalesce("component", "id").cast(kind)
    return rows.join(by_vector, "v", "left").select(
        F.col("id").alias(id),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
    )


def _met_before(filters: list[list[int]], here: int) -> np.ndarray:
    """Pairs that have a common filter below ``here``, as a boolean matrix."""
    at: dict[int, int] = {}
    row, column = [], []
    for i, own in enumerate(filters):
        for f in own:
            if f >= here:
                break
            row.append(i)
            column.append(at.setdefault(f, len(at)))
    member = np.zeros((len(filters), len(at)), dtype=np.float32)
    member[row, column] = 1
    return member @ member.T > 0
