"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments, and each segment value leads to the codes that have it. If the first a
of m segments are probed with all values within r bits of a query, and the others within r - 1, every code
at a distance below m * r + a is found: one further away in every segment would be at least that far. Radii
grow by one for half of the segments, then for the others, until the k-th distance found lies below
that bound; a query leaves as soon as it does. Codes beyond the k-th distance found so far are not met again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelyard.sizing import materialise

BITS = 64
# log2 of the codes that a segment value leads to on average. Comparing some more codes in the join costs far
# less than a wider segment, whose values within a radius are many more rows to ship.
BUCKET = 4


def sign_code(vector: str, bits: int = BITS) -> Column:
    """``bits`` (at most 64) sign bits of a vector as a number, whose own sign is the 64th bit.

    Bit i is set if the sum of the dimensions i, i + bits, i + 2 * bits, ... is positive, so a vector with
    ``bits`` dimensions has one bit for each. A null vector has no code; missing or null dimensions count as 0.
    """
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda i: F.when(
            F.aggregate(
                F.filter(F.col(vector), lambda x, at: F.pmod(at, F.lit(bits)) == i), F.lit(0.0),
                lambda total, x: total + F.coalesce(x.cast("double"), F.lit(0.0)),
            ) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i),
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.when(F.col(vector).isNotNull(), F.aggregate(folded, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def cut(bits: int, n_codes: int) -> list[tuple[int, int]]:
    """Segments (shift, width) of near equal width, ``BUCKET`` bits less than log2(n), so that buckets stay small."""
    m = max(1, min(bits, round(bits / max(2, math.log2(max(4, n_codes)) - BUCKET))))
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segments(code: Column, cuts: list[tuple[int, int]]) -> list[Column]:
    return [F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in cuts]


def _flip(number: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(number).alias("segment"), value.bitwiseXOR(mask).alias("value"))


def _probes(queries: DataFrame, cuts: list[tuple[int, int]], radius: int, numbers: range) -> DataFrame:
    """query, within, segment and every value exactly ``radius`` bits away from the query's segment, for the segments ``numbers``."""
    parts = []
    for number, ((_, width), value) in enumerate(zip(cuts, _segments(F.col("query"), cuts))):
        if radius > width or number not in numbers:
            continue
        masks = [sum(1 << b for b in flips) for flips in itertools.combinations(range(width), radius)]
        flipped = F.from_json(F.lit(str(masks)), "array<long>")
        parts.append(F.transform(flipped, _flip(number, value)))
    return queries.select("query", "within", F.explode(F.concat(*parts)).alias("probe")).select("query", "within", "probe.segment", "probe.value")


def _found_here(cuts: list[tuple[int, int]], radius: int) -> Column:
    """True where this segment and radius are the first that lead from the query to the code."""
    apart = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_segments(F.col("query"), cuts), _segments(F.col("code"), cuts))]
    others = [
        F.when(F.col("segment") > n, d > radius).when(F.col("segment") < n, d >= radius).otherwise(F.lit(True))
        for n, d in enumerate(apart)
    ]
    first = others[0]
    for one in others[1:]:
        first = first & one
    return first


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """query_id, neighbour_id, distance and rank (1 to k) for every query; both tables have id, code.

    Ties go to the smaller id; the row with the query's own id is no neighbour. Equal (id, code)
    rows count once, and rows without an id or a code are left out. Fewer than k rows give what
    there is; empty tables give no rows.

    Rows with one code share its entry in the index, with the k + 1 smallest ids of the code, all that
    any answer can need; they are chosen before the shuffle as well. Each round probes with
    the queries that are still open and keeps, for each, the codes up to the k-th distance.
    """
    rows = materialise(rows.select("id", "code").dropna().distinct(), "codes")
    queries = materialise(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).dropna().distinct(), "query-codes")
    smallest = Window.partitionBy("code").orderBy("id")
    members = materialise(rows.withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k + 1).drop("_n"), "code-members")
    codes = materialise(members.groupBy("code").agg(F.count(F.lit(1)).alias("held")), "distinct-codes")
    cuts = cut(bits, codes.count())
    entries = F.array(*[F.struct(F.lit(n).alias("segment"), v.alias("value")) for n, v in enumerate(_segments(F.col("code"), cuts))])
    index = materialise(codes.select("code", "held", F.explode(entries).alias("e")).select("e.segment", "e.value", "code", "held"), "code-index")

    by_distance = Window.partitionBy("query").orderBy("distance")
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
    open_, done, best = queries.select("query", F.lit(bits).alias("within")).distinct(), [], None
    half = (len(cuts) + 1) // 2
    rounds = [(r, n) for r in range(max(width for _, width in cuts) + 1) for n in (range(half), range(half, len(cuts))) if any(r <= cuts[i][1] for i in n)]
    for radius, numbers in rounds:
        open_ = materialise(open_, "open-queries")
        if open_.isEmpty():
            break
        # the probes are many more than the queries they come from, so neither side is broadcast
        met = (
            _probes(open_, cuts, radius, numbers).join(index.hint("merge"), ["segment", "value"])
            .filter((apart <= F.col("within")) & _found_here(cuts, radius)).select("query", "code", "held", apart.alias("distance"))
        )
        met = met if best is None else met.unionByName(best.join(open_, "query", "left_semi"))
        best = materialise(met.withColumn("_r", F.rank().over(by_distance)).filter(F.col("_r") <= k + 1).drop("_r"), "best-codes")
        # One of the rows counted may be the query itself.
        reached = best.withColumn("_sum", F.sum("held").over(by_distance)).groupBy("query").agg(
            F.min(F.when(F.col("_sum") > k, F.col("distance"))).alias("kth")
        )
        covered = reached.filter(F.col("kth") < len(cuts) * radius + numbers.stop).select("query")
        done.append(best.join(covered, "query", "left_semi"))
        # enough rows are as near as the k-th, so what is further away is in no answer
        nearer = open_.join(covered, "query", "left_anti").join(reached, "query", "left")
        open_ = nearer.select("query", F.coalesce(F.least("within", "kth"), "within").alias("within"))
    if best is None:
        best = index.select(F.col("code").alias("query"), "code", "held", F.lit(0).alias("distance")).limit(0)
    else:  # with all radii probed, queries with fewer than k neighbours are complete
        best = best.join(open_, "query", "left_semi")
    for part in done:
        best = best.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return (
        queries.join(best, "query").join(members.withColumnRenamed("id", "neighbour_id"), "code")
        .filter(F.col("query_id") != F.col("neighbour_id"))
        .select("query_id", "neighbour_id", "distance", F.row_number().over(ranked).alias("rank"))
        .filter(F.col("rank") <= k)
    )
