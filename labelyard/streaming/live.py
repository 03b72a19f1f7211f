"""Routing and reply parsing on streams.

Both are stateless row-wise expressions, so they run in append mode without a
watermark and give the batch results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.replies import reply_record
from ..functions.text import is_blank
from ..operators.route import route, split_blank


def route_stream(texts: DataFrame, schema: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Route a stream of ``item_id, text``; blank texts are left out, see ``rejected_stream``."""
    return route(texts.filter(~is_blank(F.col("text"))), schema, keep=keep)


def rejected_stream(texts: DataFrame) -> DataFrame:
    """The rows ``route_stream`` leaves out, with a reason."""
    return split_blank(texts)[1]


def stream_replies(replies: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Parse a stream of ``item_id, content`` replies."""
    rest = [c for c in replies.columns if c != "content"]
    return replies.select(*rest, reply_record(F.col("content"), labels).alias("r")).select(*rest, "r.*")


def route_outcomes(texts: DataFrame, schema: DataFrame, path: str, state: str) -> StreamingQuery:
    """Start one stream over ``item_id, text`` that writes routed rows and rejected ones.

    Each micro-batch goes to a folder of its own number in either table, which a repeated batch
    writes anew, so a restart from ``state`` neither loses nor doubles a row. The stream ends when it has
    read what there is; see ``outcomes``.
    """
    def both(batch: DataFrame, number: int) -> None:
        usable, blank = split_blank(batch)
        route(usable, schema).write.mode("overwrite").parquet(f"{path}/routed/batch={number}")
        blank.drop("text").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")

    return texts.writeStream.foreachBatch(both).option("checkpointLocation", state).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The routed and the rejected rows that ``route_outcomes`` has written, with their batch."""
    return spark.read.parquet(f"{path}/routed"), spark.read.parquet(f"{path}/rejected")
