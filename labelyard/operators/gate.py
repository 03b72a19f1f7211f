"""Behaviour checks on predictions, reported as violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .schema import collect_heads


def prediction_gate(predictions: DataFrame, schema: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Violations ``rule, item_id, head, detail`` of predictions against their schema.

    Rules: every label belongs to its head, every head is answered, a confidence
    lies in [0, 1], and a multi-label answer is not empty. With ``items``, an item
    without any answer is reported for every head; otherwise only items that have some answer are known.
    """
    heads = collect_heads(schema)
    allowed = F.create_map(*[
        x for h in heads.values()
        for x in (F.lit(h.name), F.array(*[F.lit(label) for label in h.labels]))
    ])
    multi = [h.name for h in heads.values() if h.multi_label]
    known = F.coalesce(F.try_element_at(allowed, F.col("head")), F.array().cast("array<string>"))
    foreign = F.array_except("labels", known)
    faults = F.array(
        F.when(F.size(foreign) > 0, F.struct(
            F.lit("label_outside_schema").alias("rule"),
            F.array_join(F.array_sort(foreign), ",").alias("detail"),
        )),
        F.when(~F.col("confidence").between(0, 1) | F.isnan("confidence"), F.struct(
            F.lit("confidence_out_of_range").alias("rule"),
            F.col("confidence").cast("string").alias("detail"),
        )),
        F.when(F.col("head").isin(*multi) & (F.size("labels") == 0), F.struct(
            F.lit("empty_multi_label").alias("rule"), F.lit("no label kept").alias("detail"),
        )) if multi else F.lit(None).cast("struct<rule:string,detail:string>"),
    )
    row_faults = predictions.select(
        "item_id", "head", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("f")
    ).select("f.rule", "item_id", "head", "f.detail")
    asked = predictions.select("item_id", "head")
    if items is not None:
        asked = asked.unionByName(items.select("item_id", F.lit(None).cast("string").alias("head")))
    answered = asked.groupBy("item_id").agg(F.collect_set("head").alias("answered"))
    every = F.array(*[F.lit(name) for name in heads])
    missing = answered.select(
        F.lit("head_missing").alias("rule"), "item_id",
        F.explode(F.array_except(every, "answered")).alias("head"),
        F.lit("no answer for this head").alias("detail"),
    )
    return row_faults.unionByName(missing)
