"""Exact top-k among binary codes: multi-index hashing with growing segment radii."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movecheck.llm.common import staged

BITS = 64
K = 10
#: Codes that a query is compared with in one piece where probing would cost more.
BLOCK = 50_000


def sign_codes(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """Rows (id, code): bit j of the code is 1 if the components j, j + 64, … sum to more than 0.

    No code for null and empty vectors and those with null or non-finite components.
    """
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def bit(j: Column) -> Column:
        folded = F.filter(v, lambda x, i: i % BITS == j)
        positive = F.aggregate(folded, F.lit(0.0), lambda total, x: total + x) > 0
        return F.when(positive, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint"))

    # A vector of 64 components is read once, one of another length is folded first.
    single = F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("bigint"),
        lambda code, j: code.bitwiseOR(
            F.when(F.get(v, j) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint"))
        ),
    )
    folded = F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda code, j: code.bitwiseOR(bit(j))
    )
    code = F.when(F.size(v) == BITS, single).otherwise(folded)
    return vectors.filter(fine & F.col(id).isNotNull()).select(F.col(id).alias("id"), code.alias("code"))


def _cuts(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    at = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(low, high - low) for low, high in zip(at, at[1:])]


def _segment(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def expected_segments(total: int, k: int) -> int:
    """Number of segments for which a query of random codes makes the fewest probes and matches.

    Step s searches one more segment at radius s // segments and covers distance s; the steps
    end at the distance within which ``k`` of ``total`` random codes lie.
    """
    reach, within = 0, 1
    while reach < BITS and within * total < k << BITS:
        reach += 1
        within += comb(BITS, reach)

    def rows(segments: int) -> float:
        width = -(-BITS // segments)
        return sum(comb(width, step // segments) for step in range(reach + 1)) * (1 + total / 2**width)

    return min(range(1, 17), key=rows)


def search(queries: DataFrame, codes: DataFrame, k: int = K, segments: int | None = None) -> DataFrame:
    """Rows (query_id, rank, neighbor_id, distance): the ``k`` codes nearest to each query.

    Both tables are (id, code) with 64-bit codes. The query's own id is not its neighbour;
    ties in distance go to the smaller id; fewer than ``k`` others give fewer rows. Repeated
    rows of a table are one row; null ids and codes are left out.

    The index holds every distinct code under the value of each of its segments. A round
    probes all values at radius r of a query's segments. A code that the first s segments do
    not meet within r, nor the others within r - 1, differs in segments * r + s bits or more,
    so once the k-th distance found is below that nothing can displace it and the query is
    done; the others go on with r + 1. A query that has k neighbours searches no more
    segments than its k-th distance asks for and drops codes beyond it when they are met. A
    code is taken only in the round and by the segment that meet it first, so none is met
    twice. The number of segments follows the number of codes (``expected_segments``).

    Queries far from all codes would need more probes than there are codes; what is left when
    a radius comes to that is compared with all codes, block by block, with the same result.

    Equal codes are one entry with its k + 1 smallest ids, which is all that k neighbours can
    need, kept by a rank that is limited before the shuffle; a hot segment value is split by
    skew handling, as its rows are joined and not grouped.
    """
    plain = codes.select("id", "code").dropna().distinct()
    ranked = plain.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k + 1)
    members = staged(ranked.drop("n"))
    index = staged(members.select("code").distinct())
    total = index.count()
    cuts = _cuts(segments or expected_segments(max(1, total), k))
    probes = queries.select("id", "code").dropna().distinct()
    # far: the k-th distance found so far, null before there are k.
    active = staged(probes.select(F.col("id").alias("query_id"), F.col("code").alias("query"), F.lit(None).cast("bigint").alias("far")))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = None
    done: list[DataFrame] = []
    for radius in range(max(w for _, w in cuts) + 1):
        probing = sum(comb(width, radius) for _, width in cuts) <= total
        met = _round(active, index, cuts, radius) if probing else _rest(active, index, cuts, radius)
        found = met.join(members, "code").filter(F.col("id") != F.col("query_id")).select("query_id", "id", "distance")
        if best is not None:
            found = found.unionByName(best)
        # Of a code, the ids that may be among the k: found first by code, then by id.
        best = staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
        if not probing:
            break
        reached = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        left = active.join(reached, "query_id", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("kth")))
        # Where k neighbours asked for fewer than all segments, their k-th is below this bound.
        unsure = F.col("kth").isNull() | (F.col("kth") >= len(cuts) * (radius + 1))
        active = staged(left.filter(unsure).select("query_id", "query", F.col("kth").alias("far")))
        done.append(best.join(active, "query_id", "left_anti"))
        best = best.join(active, "query_id", "left_semi")
        if active.isEmpty():
            break
    done.append(best)  # compared with all codes, or all radii are done
    final = reduce(DataFrame.unionByName, done)
    return final.select(
        "query_id", F.row_number().over(order).cast("bigint").alias("rank"), F.col("id").alias("neighbor_id"), "distance"
    )


def _apart(cuts: list[tuple[int, int]]) -> list[Column]:
    """Distance of query and code in each segment."""
    return [F.bit_count(_segment(F.col("query").bitwiseXOR(F.col("code")), low, width)) for low, width in cuts]


def _distance() -> Column:
    return F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("bigint")


def _near() -> Column:
    """Whether a code can still be among the k."""
    return F.col("far").isNull() | (_distance() <= F.col("far"))


def _round(active: DataFrame, index: DataFrame, cuts: list[tuple[int, int]], radius: int) -> DataFrame:
    """Codes that some segment meets at exactly ``radius``, none at less; (query_id, code, distance)."""
    spark = active.sparkSession
    masks = [
        (s, sum(1 << b for b in bits))
        for s, (_, width) in enumerate(cuts)
        for bits in combinations(range(width), radius)
        if radius <= width
    ]
    flips = F.broadcast(spark.createDataFrame(masks, "segment int, mask bigint"))  # as many as codes at most, see search
    own = F.array(*[_segment(F.col("query"), low, width) for low, width in cuts])
    needed = F.coalesce(F.col("far") + 1 - len(cuts) * radius, F.lit(len(cuts)))
    probes = active.select("query_id", "query", "far", needed.alias("needed"), F.posexplode(own).alias("segment", "own"))
    probes = probes.filter(F.col("segment") < F.col("needed")).join(flips, "segment")
    probes = probes.select("query_id", "query", "far", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    values = [F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), low, width).alias("value")) for s, (low, width) in enumerate(cuts)]
    entries = index.select("code", F.explode(F.array(*values)).alias("e")).select("code", "e.segment", "e.value")
    met = probes.join(entries, ["segment", "value"])
    apart = _apart(cuts)
    first = F.coalesce(
        *[F.when(d < radius, F.lit(-1)) for d in apart], *[F.when(d == radius, F.lit(s)) for s, d in enumerate(apart)]
    )
    return met.filter((first == F.col("segment")) & _near()).select("query_id", "code", _distance().alias("distance"))


def _rest(active: DataFrame, index: DataFrame, cuts: list[tuple[int, int]], radius: int) -> DataFrame:
    """Codes that no segment meets below ``radius``, by comparing the queries with blocks of all codes."""
    blocks = -(-index.count() // BLOCK)
    dealt = index.select("code", F.pmod(F.xxhash64("code"), F.lit(max(1, blocks))).alias("block"))
    asked = active.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, blocks) - 1).cast("bigint"))))
    unmet = reduce(lambda a, b: a & b, [d >= radius for d in _apart(cuts)])
    return asked.join(dealt, "block").filter(unmet & _near()).select("query_id", "code", _distance().alias("distance"))
