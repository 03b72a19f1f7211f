"""Columns that an operator only passes on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns an operator doesn't read under names no operator uses, and the way back.

    The way back is for ``withColumnsRenamed``; names with a blank never occur inside an operator.
    """
    away = {c: f"column {i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}
