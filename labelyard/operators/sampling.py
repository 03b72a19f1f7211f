"""Reproducible samples and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import seed_order
from ..sizing import broadcast_if_small, materialise
from .ranks import numbered

# Up to this many rows a per-task top-n merge is the cheapest exact plan.
TOP_N_ROWS = 20_000


def _first_by(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First ``n`` rows by ``order``; NULL keys come first."""
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    if n <= TOP_N_ROWS:
        return df.orderBy(*order).limit(n)
    # Beyond that no single task may hold the result: rows are numbered in ranges.
    return numbered(df, order, "_place").filter(F.col("_place") <= n).drop("_place")


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str = "item_id") -> DataFrame:
    """Seeded shuffle, then the first ``n`` rows. Equal on any cluster and partitioning."""
    return _first_by(df, n, [seed_order(seed, F.col(key)), F.col(key)])


def first_n(df: DataFrame, n: int | None, key: str = "item_id") -> DataFrame:
    """The shared slice every system is scored on; ``None`` and 0 keep all rows."""
    if not n:
        return df
    return _first_by(df, n, [F.col(key)])


def nested_subsets(
    df: DataFrame, sizes: list[int], seed: int = 0, key: str = "item_id"
) -> dict[int, DataFrame]:
    """Random training subsets without replacement; smaller ones lie inside larger ones.

    The rows are put into their random order once and stored with their places. A size beyond the
    table has all its rows.
    """
    placed = materialise(numbered(df, [seed_order(seed, F.col(key)), F.col(key)], "_place"), "placed")
    return {size: placed.filter(F.col("_place") <= size).drop("_place") for size in sorted(sizes)}


def split_by_hash(
    df: DataFrame, fraction: float, seed: int = 0, key: str = "item_id"
) -> tuple[DataFrame, DataFrame]:
    """Disjoint, exhaustive row split decided row by row from a hash of the key."""
    draw = F.conv(F.substring(seed_order(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    left = draw < int(fraction * 2**32)
    return df.filter(left), df.filter(~left)


def keep_labels(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label belongs to a label subset."""
    return df.join(broadcast_if_small(labels.select(label).distinct()), label, "left_semi")
