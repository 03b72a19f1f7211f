"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution whose mean is the
repetition rate of its source. The draw inverts the distribution at a number hashed from the
document's id and a seed, so it is the same on any cluster and in any run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelyard.llm.columns import set_aside
from labelyard.sizing import broadcast_if_small

#: A mean above this is drawn as a sum of several smaller Poisson draws, as exp(-mean) vanishes.
LARGEST_MEAN = 256.0


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\\N"))


def hashed(*parts: Column) -> Column:
    """A whole number in [0, 2^52) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, exponent: float = 0.5, epochs: float = 1.0, by: str = "source") -> DataFrame:
    """mix_key, mean: repetitions that bring each source to its target share of the characters.

    The target share of a source is proportional to its characters to the power ``exponent``, and
    all sources together give ``epochs`` times the characters there are. A source without
    characters is kept once on average. The null source is a source.
    """
    sizes = docs.groupBy(_key(by).alias("mix_key")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size")
    ).withColumn("wanted", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(exponent))))
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum("wanted").alias("all_wanted"))
    mean = epochs * F.col("all_size") * F.col("wanted") / F.col("all_wanted") / F.col("size")
    return sizes.join(F.broadcast(whole)).select("mix_key", F.coalesce(mean, F.lit(1.0)).alias("mean"))


def _cumulative(mean: Column) -> Column:
    """P(k <= 0), P(k <= 1), ... until the rest is below the resolution of the hash."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        total = state["total"] + p
        return F.struct(p.alias("p"), total.alias("total"), F.concat(state["sums"], F.array(total)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["sums"])


def replicate(docs: DataFrame, rates: DataFrame, by: str = "source", seed: int = 17) -> DataFrame:
    """Every document as often as it is drawn, with ``copy`` (from 0), in an order without a pattern.

    ``rates`` has mix_key and mean, one row per source. The rows are dealt to partitions by a hash of
    id, copy and seed and sorted by it there, which is the global shuffle; ``shuffle_key`` keeps it.
    Rows that share an id share their draw. Null ids, sources and texts are values like any other,
    a source without a rate is left out, an empty table stays empty, and all columns are kept
    (``copy`` and ``shuffle_key`` are overwritten if they exist).
    """
    docs, back = set_aside(docs.drop("copy", "shuffle_key"), ("doc_id", "text", "lang", "source", by))
    draws = F.greatest(F.ceil(F.col("mean") / LARGEST_MEAN), F.lit(1)).cast("int")
    tables = rates.select(
        F.col("mix_key").alias("_mix_key"), draws.alias("_draws"),
        _cumulative(F.greatest(F.col("mean"), F.lit(0.0)) / draws).alias("_sums"),
    )
    ident = _key("doc_id")

    def draw(n: Column) -> Column:
        u = hashed(F.lit(str(seed)), n.cast("string"), F.col("_ident")) / F.lit(float(2**52))
        return F.size(F.filter("_sums", lambda total: total <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda have, n: have + draw(n))
    drawn = (
        docs.withColumns({"_mix_key": _key(by), "_ident": ident})
        .join(broadcast_if_small(tables), "_mix_key")
        .withColumn("_count", count)
        .filter("_count > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
        .withColumn("shuffle_key", hashed(F.lit(str(seed)), F.lit("order"), F.col("_ident"), F.col("copy").cast("string")))
        .drop("_mix_key", "_ident", "_draws", "_sums", "_count")
        .withColumnsRenamed(back)
    )
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return drawn.repartition(int(n), "shuffle_key").sortWithinPartitions("shuffle_key")
