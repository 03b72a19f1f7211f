"""Retry attempts folded into one outcome per item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_attempts(
    attempts: DataFrame, key: str = "item_id", order: str | list[str] = "attempt"
) -> DataFrame:
    """Outcome per item from ``attempts(key, order, status, content, error)``.

    The first attempt that cannot be improved on decides: a success, or a client
    error other than 429. Without one, the last error stands. Only the deciding
    rows survive the map-side combine, so an item with very many attempts is not
    gathered anywhere.
    """
    order = [order] if isinstance(order, str) else order
    status = F.col("status")
    ok = status.between(200, 399)
    final = ok | (status.between(400, 499) & (status != 429))
    row = F.struct(*order, "status", "content", "error")
    folded = attempts.groupBy(key).agg(
        F.min(F.when(final, row)).alias("decided"), F.max(row).alias("last")
    )
    outcome = F.coalesce("decided", "last")
    good = outcome["status"].between(200, 399)
    return folded.select(
        key,
        F.when(good, outcome["content"]).alias("content"),
        F.when(good, None)
        .otherwise(F.coalesce(outcome["error"], F.lit("unknown error"))).alias("error"),
        F.when(good, "success").when(F.col("decided").isNotNull(), "rejected")
        .otherwise("exhausted").alias("outcome"),
    )
