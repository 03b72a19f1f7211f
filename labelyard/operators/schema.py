"""Label schemas as rows: building, validating, fingerprinting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import broadcast_if_small, take_bounded
from ..types import HEADS, MAX_LABELS

# --- fixed values -------------------------------------------------------------
DEFAULT_THRESHOLD = 0.4
# Above this many labels, descriptions dominate the input of a scorer. The figures
# in the warning were published for a neural encoder.
DESCRIBED_LABELS_WARN = 25
INFLATION_WARNING = "note: descriptions inflate input ~3.9x here (measured ~8.6x slower)"
# --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Head:
    """One question put to a scorer: a name and its answer labels."""

    name: str
    labels: Sequence[str]
    multi_label: bool = False
    cls_threshold: float = DEFAULT_THRESHOLD
    described: dict[str, str] | None = None


def build_schema(
    labels: DataFrame,
    head: str = "intent",
    *,
    described: bool = False,
    multi_label: bool = False,
    threshold: float = DEFAULT_THRESHOLD,
    label_subset: DataFrame | None = None,
) -> DataFrame:
    """Schema rows of one head from ``labels(label, ord[, description])``.

    ``multi_label`` beats ``described``. A described head keeps only the labels
    that have text, and is a plain head when none has.
    """
    if "description" not in labels.columns:
        labels = labels.withColumn("description", F.lit(None).cast("string"))
    if label_subset is not None:
        subset = broadcast_if_small(label_subset.select("label").distinct())
        labels = labels.join(subset, "label", "left_semi")
    text = F.lit(None).cast("string")
    if described and not multi_label:
        has_text = F.coalesce(F.col("description"), F.lit("")) != ""
        usable = labels.filter(has_text)
        if usable.limit(1).count():
            labels, text = usable, F.col("description")
    return labels.select(
        F.lit(head).alias("head"),
        "label",
        F.col("ord").cast("int").alias("ord"),
        text.alias("description"),
        F.lit(multi_label).alias("multi_label"),
        F.lit(float(threshold) if multi_label else None).cast("double").alias("cls_threshold"),
    )


def schema_from_heads(spark: SparkSession, heads: Sequence[Head]) -> DataFrame:
    """Schema rows of a request; refuses a head without labels or with too many."""
    rows = []
    for head in heads:
        if not head.labels:
            raise ValueError(f"head {head.name!r} has no labels")
        if len(head.labels) > MAX_LABELS:
            raise ValueError(f"label set too large (max {MAX_LABELS})")
        described = head.described if head.described and not head.multi_label else None
        for pos, label in enumerate(described or head.labels):
            rows.append((
                head.name, label, pos, described[label] if described else None,
                head.multi_label, float(head.cls_threshold) if head.multi_label else None,
            ))
    return spark.createDataFrame(rows, HEADS)


# What the driver takes of one request's schema.
SCHEMA_ROWS = 1_000_000


def head_limits(heads: DataFrame, schema: DataFrame) -> DataFrame:
    """Label count and verdict per head, for heads and labels that are tables."""
    counts = schema.groupBy("head").agg(F.count("label").alias("n_labels"))
    n = F.coalesce(F.col("n_labels"), F.lit(0))
    return heads.select("head").distinct().join(counts, "head", "left").select(
        "head",
        n.alias("n_labels"),
        F.when(n == 0, F.concat(F.lit("head '"), F.col("head"), F.lit("' has no labels")))
        .when(n > MAX_LABELS, f"label set too large (max {MAX_LABELS})")
        .alias("error"),
    )


def collect_heads(schema: DataFrame, max_rows: int = SCHEMA_ROWS) -> dict[str, Head]:
    """Schema rows on the driver; any number of heads, each with at most as many labels as the contract has."""
    rows = take_bounded(schema, max_rows, "label schema")
    grouped: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["head"], r["ord"])):
        grouped.setdefault(row["head"], []).append(row)
    heads = {}
    for name, members in grouped.items():
        if len(members) > MAX_LABELS:
            raise ValueError(f"label set too large (max {MAX_LABELS})")
        described = {r["label"]: r["description"] for r in members if r["description"]}
        threshold = members[0]["cls_threshold"]
        heads[name] = Head(
            name, [r["label"] for r in members], bool(members[0]["multi_label"]),
            DEFAULT_THRESHOLD if threshold is None else threshold, described or None,
        )
    return heads


def schema_fingerprint(schema: DataFrame) -> DataFrame:
    """First 16 hex digits of the SHA-256 of the schema as sorted-key JSON.

    Label order counts, head order does not. The JSON text is the one a request
    body with the same schema serialises to.
    """
    def quote(c):
        return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)

    def listed(rows, entry):
        return F.array_join(F.transform(rows, entry), ", ")

    per_head = schema.groupBy("head").agg(
        F.bool_or("multi_label").alias("multi"),
        F.max("cls_threshold").alias("threshold"),
        F.count("description").alias("n_described"),
        F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("ordered"),
        F.array_sort(F.collect_list(F.struct("label", "description"))).alias("by_name"),
    )
    plain = F.concat(F.lit("["), listed(F.col("ordered"), lambda r: quote(r["label"])), F.lit("]"))
    described = F.concat(
        F.lit('{"labels": {'),
        listed(
            F.col("by_name"),
            lambda r: F.concat(quote(r["label"]), F.lit(": "), quote(r["description"])),
        ),
        F.lit("}}"),
    )
    multi = F.concat(
        F.lit('{"cls_threshold": '), F.col("threshold").cast("string"),
        F.lit(', "labels": '), plain, F.lit(', "multi_label": true}'),
    )
    body = F.concat(
        quote(F.col("head")), F.lit(": "),
        F.when(F.col("multi"), multi).when(F.col("n_described") > 0, described).otherwise(plain),
    )
    whole = per_head.select("head", body.alias("body")).agg(
        F.array_sort(F.collect_list(F.struct("head", "body"))).alias("heads")
    )
    text = F.concat(F.lit("{"), listed(F.col("heads"), lambda r: r["body"]), F.lit("}"))
    return whole.select(
        F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"), text.alias("schema_json")
    )


def inflation_note(schema: DataFrame) -> DataFrame:
    """Label count per head, with a warning when many labels carry descriptions."""
    n = F.count("label")
    return schema.groupBy("head").agg(
        n.alias("n_labels"),
        F.concat(F.lit("schema: "), n.cast("string"), F.lit(" labels")).alias("note"),
        F.when(
            (F.count("description") > 0) & (n > DESCRIBED_LABELS_WARN),
            INFLATION_WARNING,
        ).alias("warning"),
    )
