"""Column layouts shared by every module.

Undefined numbers are NULL everywhere (never NaN), label sets are sorted
distinct ``array<string>``, and rows are matched by ``item_id``, never by
position.
"""

from pyspark.sql import types as T

LABELS = T.ArrayType(T.StringType())

FIXTURE_CSV = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("description", T.StringType()),
])

SOURCE = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("split", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("source", SOURCE),
    T.StructField("note", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("n_labels", T.LongType()),
    T.StructField("labels", LABELS),
    T.StructField("labels_with_description", LABELS),
    T.StructField("class_counts", T.MapType(T.StringType(), T.LongType())),
])

HEADS = T.StructType([
    T.StructField("head", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("multi_label", T.BooleanType()),
    T.StructField("cls_threshold", T.DoubleType()),
])

UNAVAILABLE = T.StructType([
    T.StructField("system", T.StringType()),
    T.StructField("reason", T.StringType()),
])

PANEL_COLUMNS = [
    "name", "n", "accuracy", "ci_low", "ci_high", "macro_f1", "p50_ms",
    "p95_ms", "cost_per_1k_usd", "cost_status", "notes",
]

# The largest label set one head may carry (fixed limit of the request contract).
MAX_LABELS = 512
# What the driver may hold: one row per system.
MAX_SYSTEMS = 10_000
