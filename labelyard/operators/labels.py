"""Label sets, label resolution, descriptions and label splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import is_blank, seed_order
from ..sizing import broadcast_if_small
from .ranks import numbered

OUT_OF_SCOPE = "oos"
# Up to this many labels are fetched, which reads the items once, and numbered in one window;
# more are numbered in ranges. Both give the same numbers.
FETCHED_LABELS = 20_000


def _numbered(labels: DataFrame, order: list[Column], name: str) -> DataFrame:
    labels = labels.select("label")
    rows = labels.limit(FETCHED_LABELS + 1).collect()
    if len(rows) > FETCHED_LABELS:
        return numbered(labels, order, name)
    known = labels.sparkSession.createDataFrame(rows, labels.schema)
    return known.withColumn(name, F.row_number().over(W.orderBy(*order)))


def label_set(items: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels with a zero-based position ``ord``."""
    distinct = items.select(F.col(label).alias("label")).distinct()
    return _numbered(distinct, [F.col("label")], "_pos").select(
        "label", (F.col("_pos") - 1).cast("int").alias("ord")
    )


def label_index(items: DataFrame, label: str = "label") -> DataFrame:
    """Label to model index by sorted label, joined back to the items."""
    index = label_set(items, label).select(F.col("label").alias("_label"), F.col("ord").alias("label_index"))
    same = items[label].eqNullSafe(F.col("_label"))
    return items.join(broadcast_if_small(index), same).select(*items.columns, "label_index")


def class_counts(items: DataFrame, label: str = "label") -> DataFrame:
    return items.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def top_classes(items: DataFrame, k: int = 3, label: str = "label") -> DataFrame:
    return class_counts(items, label).orderBy(F.desc("n"), "label").limit(k)


def fill_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL cells become empty text."""
    return df.na.fill("", subset=columns)


def label_descriptions(
    items: DataFrame, label: str = "label", description: str = "description",
    order: str = "item_id",
) -> DataFrame:
    """One description per label: the last row with a non-blank one wins."""
    text = F.col(description)
    return (
        items.filter(~is_blank(text))
        .groupBy(F.col(label).alias("label"))
        .agg(F.max_by(text, F.struct(F.col(order), text)).alias("description"))
    )


def described_label_set(labels: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Every label, with its description or NULL."""
    return labels.join(broadcast_if_small(descriptions), "label", "left")


def description_coverage(labels: DataFrame) -> DataFrame:
    """Label count and share of labels that carry text; 0.0 for an empty set."""
    has_text = F.coalesce(F.col("description"), F.lit("")) != ""
    return labels.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.coalesce(F.avg(has_text.cast("double")), F.lit(0.0)).alias("coverage"),
    )


def resolve_labels(
    df: DataFrame,
    label_id: str,
    *,
    names: DataFrame | None = None,
    fallback: dict[int, str] | None = None,
    label_text: str | None = None,
    oos_label: str = OUT_OF_SCOPE,
) -> DataFrame:
    """Add ``label``, and ``description`` where the label dimension has one.

    A NULL id is out of scope before anything else is looked at. Otherwise an
    existing text column is taken as it is; without one the id is looked up in
    ``names(id, name[, description])``, then in ``fallback``, then kept as text.
    """
    raw = F.col(label_id)
    if label_text is not None:
        return df.withColumn(
            "label",
            F.when(raw.isNull(), oos_label).otherwise(F.col(label_text).cast("string")),
        )
    resolved = raw.cast("string")
    if fallback:
        table = F.create_map(*[F.lit(x) for k, v in fallback.items() for x in (int(k), v)])
        resolved = F.coalesce(F.try_element_at(table, raw.cast("int")), resolved)
    if names is not None:
        cols = [c for c in ("name", "description") if c in names.columns]
        dim = names.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in cols])
        df = df.join(broadcast_if_small(dim), raw == F.col("_id"), "left")
        resolved = F.coalesce(F.col("_name"), resolved)
    out = df.withColumn("label", F.when(raw.isNull(), oos_label).otherwise(resolved))
    if names is not None:
        if "description" in names.columns:
            out = out.withColumn("description", F.coalesce(F.col("_description"), F.lit("")))
        out = out.drop("_id", "_name", "_description")
    return out


def split_labels(labels: DataFrame, seed: int = 0, fraction: float = 0.5) -> DataFrame:
    """Two disjoint, exhaustive halves of a label set as a column ``side``."""
    distinct = labels.select("label").distinct()
    ordered = _numbered(distinct, [seed_order(seed, F.col("label")), F.col("label")], "_pos")
    total = F.count(F.lit(1)).over(W.partitionBy())
    return ordered.withColumn("_n", total).select(
        "label",
        F.when(F.col("_pos") <= F.floor(F.col("_n") * F.lit(float(fraction))), "a")
        .otherwise("b").alias("side"),
    )
