"""Intervals and paired tests from counts.

Resampling n yes/no outcomes with replacement gives a Binomial(n, k/n) number of
hits, and resampling paired outcomes a multinomial over the four agreement cells.
So a handful of counts per system or pair is all the tests need, whatever the
number of items, and the bootstrap distribution can be evaluated exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ALPHA = 0.05
RESAMPLES = 10_000
SEED = 0

# Probability beyond this many standard deviations is below 1e-30.
_REACH = 12.0

INTERVAL = "struct<ci_low: double, ci_high: double>"
PAIR_TEST = (
    "struct<diff: double, ci_low: double, ci_high: double, p_value: double, "
    "mcnemar_p: double>"
)


def _binomial(n: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes around the mean and their probabilities, by ratios of neighbours."""
    reach = _REACH * np.sqrt(n * p * (1 - p)) + 20
    low, high = max(0, int(n * p - reach)), min(n, int(n * p + reach) + 1)
    x = np.arange(low, high + 1, dtype=np.float64)
    if low == high or p in (0.0, 1.0):
        return x, (x == round(n * p)).astype(float)
    steps = np.log((n - x[:-1]) / (x[:-1] + 1)) + np.log(p) - np.log1p(-p)
    log_mass = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.exp(log_mass - log_mass.max())
    return x, mass / mass.sum()


def _quantiles(x: np.ndarray, mass: np.ndarray, alpha: float) -> tuple[float, float]:
    cdf = np.cumsum(mass)
    ends = np.searchsorted(cdf, [alpha / 2, 1 - alpha / 2])
    low, high = np.minimum(ends, len(x) - 1)
    return float(x[low]), float(x[high])


def _interval(n: int, k: int, alpha: float, draws: tuple[int, int] | None) -> tuple:
    if not n:
        return None, None
    if draws:
        resamples, seed = draws
        hits = np.random.default_rng(seed).binomial(n, k / n, resamples) / n
        return tuple(np.percentile(hits, [100 * alpha / 2, 100 * (1 - alpha / 2)]))
    low, high = _quantiles(*_binomial(n, k / n), alpha)
    return low / n, high / n


def _difference(n: int, n10: int, n01: int) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of the resampled count difference.

    The characteristic function of one item, raised to the n-th power, is sampled
    on a grid wider than the mass and transformed back.
    """
    if n10 + n01 == 0:
        return np.zeros(1), np.ones(1)
    a, b = n10 / n, n01 / n
    centre = n10 - n01
    spread = np.sqrt(n * (a + b - (a - b) ** 2))
    size = 1 << int(np.ceil(np.log2(2 * _REACH * spread + 64)))
    t = 2 * np.pi * np.fft.fftfreq(size)
    one = np.log1p(a * np.expm1(1j * t) + b * np.expm1(-1j * t))
    # Outcomes centre - size/2 ... centre + size/2 - 1, shifted to start at 0.
    start = centre - size // 2
    mass = np.fft.fft(np.exp(n * one - 1j * t * start)).real / size
    x = start + np.arange(size, dtype=np.float64)
    mass = np.where(np.abs(x) <= n, np.maximum(mass, 0.0), 0.0)
    return x, mass / mass.sum()


def _two_sided(at_most: float, at_least: float) -> float:
    return float(min(1.0, 2 * min(at_most, at_least)))


def _mcnemar(b: int, c: int) -> float:
    """Exact two-sided binomial test on the discordant items."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    x, mass = _binomial(n, 0.5)
    if k < x[0]:
        return 0.0  # further out than double precision can express
    return float(min(1.0, 2 * mass[x <= k].sum()))


def _pair(n11: int, n10: int, n01: int, n00: int, alpha: float, draws) -> tuple:
    n = n11 + n10 + n01 + n00
    if n == 0:
        return None, None, None, None, _mcnemar(n10, n01)
    if draws:
        resamples, seed = draws
        cells = np.random.default_rng(seed).multinomial(
            n, np.array([n11, n10, n01, n00]) / n, resamples
        )
        delta = (cells[:, 1] - cells[:, 2]) / n
        low, high = np.percentile(delta, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        p = _two_sided((delta <= 0).mean(), (delta >= 0).mean())
    else:
        x, mass = _difference(n, n10, n01)
        low, high = (v / n for v in _quantiles(x, mass, alpha))
        p = _two_sided(mass[x <= 0].sum(), mass[x >= 0].sum())
    return (n10 - n01) / n, float(low), float(high), p, _mcnemar(n10, n01)


def _draws(method: str, resamples: int, seed: int) -> tuple[int, int] | None:
    if method == "exact":
        return None
    if method == "monte_carlo":
        return resamples, seed
    raise ValueError(f"unknown method {method!r}")


def bootstrap_ci(
    n: Column, n_correct: Column, *, method: str = "exact", alpha: float = ALPHA,
    resamples: int = RESAMPLES, seed: int = SEED,
) -> Column:
    """Percentile-bootstrap interval of an accuracy, as a struct; NULL ends for n = 0."""
    draws = _draws(method, resamples, seed)

    @F.pandas_udf(INTERVAL)
    def interval(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        ends = [_interval(int(a), int(b), alpha, draws) for a, b in zip(n, k)]
        return pd.DataFrame(ends, columns=["ci_low", "ci_high"], dtype="float64")

    return interval(n.cast("long"), n_correct.cast("long"))


def pair_cells(correctness: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Agreement counts ``n11, n10, n01, n00`` for each pair of systems.

    Each item becomes one row with a column per system; all pairs are then counted
    in one aggregation, so items are shuffled once and no pair of rows is emitted.
    An item that only one of the two systems answered, or that was answered
    twice, raises.
    """
    names = sorted({s for pair in pairs for s in pair})
    column = {s: f"s{i}" for i, s in enumerate(names)}
    schema = "a string, b string, n11 long, n10 long, n01 long, n00 long"
    if not pairs:
        return correctness.sparkSession.createDataFrame([], schema)
    wide = (
        correctness.filter(F.col("system").isin(*names))
        .groupBy("item_id")
        .agg(
            *[F.max(F.when(F.col("system") == s, F.col("correct"))).alias(c)
              for s, c in column.items()],
            *[F.count_if(F.col("system") == s).alias(f"{c}_rows") for s, c in column.items()],
        )
    )

    def cells(a: str, b: str) -> Column:
        x, y = F.col(column[a]), F.col(column[b])
        rows_a, rows_b = F.col(f"{column[a]}_rows"), F.col(f"{column[b]}_rows")
        return F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"),
            F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"),
            F.count_if((rows_a != rows_b) | (rows_a > 1)).alias("unpaired"),
        )

    counted = wide.agg(F.array(*[cells(a, b) for a, b in pairs]).alias("p"))
    rows = counted.select(F.explode("p").alias("p")).select("p.*")
    message = F.concat(
        F.col("a"), F.lit(" and "), F.col("b"), F.lit(" were not scored on the same items: "),
        F.col("unpaired").cast("string"), F.lit(" differ; a paired comparison is not valid"),
    )
    checked = F.when(F.col("unpaired") > 0, F.raise_error(message).cast("long")).otherwise(F.col("n11"))
    return rows.select("a", "b", checked.alias("n11"), "n10", "n01", "n00")


def compare_pairs(
    cells: DataFrame, *, method: str = "exact", alpha: float = ALPHA,
    resamples: int = RESAMPLES, seed: int = SEED,
) -> DataFrame:
    """Accuracy difference a - b, its interval, bootstrap p and exact McNemar per pair.

    ``significant`` follows the bootstrap p-value; the McNemar verdict stands
    beside it.
    """
    draws = _draws(method, resamples, seed)

    @F.pandas_udf(PAIR_TEST)
    def test(n11: pd.Series, n10: pd.Series, n01: pd.Series, n00: pd.Series) -> pd.DataFrame:
        rows = [
            _pair(int(w), int(x), int(y), int(z), alpha, draws)
            for w, x, y, z in zip(n11, n10, n01, n00)
        ]
        names = ["diff", "ci_low", "ci_high", "p_value", "mcnemar_p"]
        return pd.DataFrame(rows, columns=names, dtype="float64")

    tested = cells.withColumn("t", test("n11", "n10", "n01", "n00"))
    return tested.select(
        "a", "b", "t.diff", "t.ci_low", "t.ci_high", "t.p_value",
        (F.col("t.p_value") < 0.05).alias("significant"),
        F.struct(
            F.col("n10").alias("b"), F.col("n01").alias("c"), F.col("t.mcnemar_p").alias("p_value")
        ).alias("mcnemar"),
        (F.col("t.mcnemar_p") < 0.05).alias("mcnemar_significant"),
    )
