"""Exact order statistics per group, and places in a total order, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sizing import broadcast_if_small, materialise

# A bracket is narrowed between so many values of a quantile sketch of itself, until it holds at most
# SMALL_GROUP rows; only then are its values ranked in one task.
GRID, ACCURACY = 64, 1_000
SMALL_GROUP = 100_000

Rank = tuple[float, Callable[[Column], Column]]

MEDIAN_LOW: Rank = (0.5, lambda n: F.floor((n - 1) / 2))
MEDIAN_HIGH: Rank = (0.5, lambda n: F.floor(n / 2))


def nearest_rank(q: float) -> Rank:
    """Sorted element at ``min(n - 1, floor(q * n))``."""
    return (q, lambda n: F.least(n - 1, F.floor(F.lit(q) * n)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, in the total ``order``.

    Rows are stored in ranges of the order; a range is numbered by itself, behind the counts
    of the ranges before it, so no task holds more than a range.
    """
    ranges = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row per range
    offsets = broadcast_if_small(counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before")))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)).cast("long") + F.col("_before")
    return ranges.join(offsets, "_range").withColumn(name, place).select(*df.columns, name)


def order_statistics(
    df: DataFrame, by: list[str], value: str, ranks: dict[str, Rank]
) -> DataFrame:
    """Values at zero-based ranks: one row per group with ``n`` and a column per name.

    Every wanted rank has a bracket, at first the whole group. A round counts how many rows of a large
    bracket lie at and between the values of a quantile sketch of it, which needs a few counters per
    group and task, and goes on with the part that holds the rank. The counts are exact, so the sketch only
    decides how fast a bracket shrinks; a value that many rows share is found by its count.
    Rounds grow with the logarithm of a group's size, and no task ranks more than ``SMALL_GROUP`` rows.
    """
    v = F.col(value)
    rows = df.select(*by, v).filter(v.isNotNull())
    names = list(ranks)
    sketch = F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], ACCURACY)
    group = rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), sketch.alias("at"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ranks[name][1](F.col("n")).cast("long").alias("rank")) for name in names])
    fields = ["name", "rank", "lo", "hi", "closed", "inside", "at"]
    open_ = group.select(*by, "n", F.explode(wanted).alias("w"), "lo", "hi", "at").select(
        *by, "n", F.col("w.name").alias("name"), F.col("w.rank").alias("rank"), "lo", "hi",
        F.lit(True).alias("closed"), F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.col("n")).alias("inside"), "at",
    )
    state = broadcast_if_small(materialise(open_, "brackets"))
    within = (v > F.col("lo")) & (v < F.col("hi")) | F.col("closed") & ((v == F.col("lo")) | (v == F.col("hi")))
    while (state.agg(F.max("inside")).first()[0] or 0) > SMALL_GROUP:
        wide, rest = state.filter(F.col("inside") > SMALL_GROUP), state.filter(F.col("inside") <= SMALL_GROUP)
        cuts = F.array_distinct(F.concat(F.array("lo"), "at", F.array("hi")))
        wide = wide.withColumn("cuts", F.array_sort(cuts)).drop("at")
        # even parts are the cuts themselves, odd ones what lies between two of them
        part = 2 * F.size(F.filter("cuts", lambda x: x < v)) - F.when(F.array_contains("cuts", v), 0).otherwise(1)
        keep = [*by, "n", "name", "rank", "cuts"]
        counted = rows.join(broadcast_if_small(wide), by).filter(within).groupBy(*keep, part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
        before = F.sum("c").over(W.partitionBy(*by, "name").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        held = counted.withColumn("before", F.coalesce(before, F.lit(0))).filter(
            (F.col("before") <= F.col("rank")) & (F.col("before") + F.col("c") > F.col("rank"))
        )
        first = F.floor(F.col("part") / 2).cast("int")
        exact = F.col("part") % 2 == 0
        narrowed = held.select(
            *by, "n", "name", (F.col("rank") - F.col("before")).alias("rank"), F.get("cuts", first).alias("lo"),
            F.get("cuts", F.when(exact, first).otherwise(first + 1)).alias("hi"), exact.alias("closed"),
            F.when(exact, 1).otherwise(F.col("c")).alias("inside"),
        )
        narrowed = broadcast_if_small(materialise(narrowed, "brackets"))
        again = rows.join(narrowed.filter(F.col("inside") > SMALL_GROUP), by).filter(within).groupBy(*by, "name").agg(sketch.alias("at"))
        narrowed = narrowed.join(broadcast_if_small(again), [*by, "name"], "left")
        state = broadcast_if_small(materialise(rest.select(*by, "n", *fields).unionByName(narrowed.select(*by, "n", *fields)), "brackets"))
    single = (F.col("lo") == F.col("hi")) & F.col("closed")
    counted = (
        rows.join(broadcast_if_small(state.filter(~single).drop("at")), by).filter(within)
        .groupBy(*by, "n", "name", "rank", v.alias("_value")).agg(F.count(F.lit(1)).alias("c"))
    )
    running = W.partitionBy(*by, "name").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    found = counted.withColumn("upto", F.sum("c").over(running)).filter(
        (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))
    ).select(*by, "n", "name", "_value").unionByName(state.filter(single).select(*by, "n", "name", F.col("lo").alias("_value")))
    return found.groupBy(*by, "n").agg(
        *[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in names]
    )
