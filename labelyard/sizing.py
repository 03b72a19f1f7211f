"""Size checks that decide between broadcasting, inlining and shuffling."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
PINNED_ROWS = 2_000
WIDE_ROWS = 8


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` of content.

    The limit makes the check itself bounded: it never reads more than
    ``max_rows + 1`` rows.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        simple = field.dataType.simpleString()
        if simple == "string":
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif simple.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            width = width + F.lit(8)
    row = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("size"))
        .first()
    )
    return row["n"] <= max_rows and (row["size"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after its size was checked.

    A tiny table, such as a label set or one row per system, is fetched by the
    check itself and kept, so whatever it was computed from is not read again. A
    larger side stays an ordinary equi-join input, where adaptive execution splits
    skewed partitions.
    """
    rows = df.limit(PINNED_ROWS + 1).collect()
    if len(rows) <= PINNED_ROWS:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return F.broadcast(df) if fits(df, max_rows) else df


def take_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table that must be small, and refuse when it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return rows


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a table scan that has fewer splits than cores.

    For row-wise work that costs far more than moving its input. A table with
    enough row groups is returned as it is, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def workspace(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates and cached artifacts.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder().name


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """One folder per local process, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="labelyard-", ignore_cleanup_errors=True)


def store(df: DataFrame, name: str, wide: bool = False) -> str:
    """Write an intermediate to the shared folder; returns its path."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.row.count.limit", WIDE_ROWS) if wide else df.write
    writer.parquet(path)
    return path


def materialise(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write an intermediate to the shared folder once and read it back.

    For results that several later steps scan: the table survives lost executors
    and cuts the lineage. A reader takes up to 4,096 rows at a time, but none beyond a row
    group, so ``wide`` rows, of a megabyte or so, are written a few to a group.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name, wide))
