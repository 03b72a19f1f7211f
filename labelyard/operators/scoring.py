"""Exact-set match, accuracy, macro-F1 and the majority floor.

Predictions are ``system, item_id, labels``; items are ``item_id, gold``. All
label arrays are canonical (see ``functions.payloads.label_array``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.payloads import label_array
from ..sizing import broadcast_if_small, take_bounded
from ..types import MAX_SYSTEMS


def system_names(predictions: DataFrame) -> list[str]:
    rows = take_bounded(predictions.select("system").distinct(), MAX_SYSTEMS, "list of systems")
    return sorted(r["system"] for r in rows)


def pairing_faults(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Items a system skipped, invented or answered twice: must be empty.

    One shuffle of keys; the systems of an item are counted, not listed.
    """
    systems = system_names(predictions)
    rows = predictions.select("item_id", "system").unionByName(
        items.select("item_id", F.lit(None).cast("string").alias("system"))
    )
    per_item = rows.groupBy("item_id").agg(
        F.count_if(F.col("system").isNull()).alias("in_items"),
        *[F.count_if(F.col("system") == s).alias(f"s{i}") for i, s in enumerate(systems)],
    )
    checks = F.array(*[
        F.when(
            (F.col(f"s{i}") != 1) | (F.col("in_items") != 1),
            F.struct(
                F.lit(s).alias("system"),
                F.when((F.col("in_items") == 0) & (F.col(f"s{i}") > 0), "unknown item")
                .when((F.col("in_items") > 0) & (F.col(f"s{i}") == 0), "missing prediction")
                .when(F.col(f"s{i}") > 1, "duplicate prediction")
                .when(F.col("in_items") > 1, "duplicate item").alias("fault"),
            ),
        )
        for i, s in enumerate(systems)
    ]) if systems else F.array().cast("array<struct<system:string,fault:string>>")
    return (
        per_item.select("item_id", F.explode(checks).alias("c"))
        .filter(F.col("c.fault").isNotNull())
        .select("c.system", "item_id", "c.fault")
    )


def require_paired(predictions: DataFrame, items: DataFrame) -> None:
    """Raise unless every system answered exactly the given items once each."""
    first = pairing_faults(predictions, items).limit(1).collect()
    if first:
        f = first[0]
        raise ValueError(
            f"length mismatch: {f['system']!r} has a {f['fault']} for item {f['item_id']}"
        )


def score_items(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Correctness per system and item: the predicted set must equal the gold set.

    Answers and items meet in one shuffle, combined before it, with a column per system. The
    same pass fails with "length mismatch" unless every system answered every item once.
    """
    systems = system_names(predictions)
    none = F.lit(None).cast("array<string>")
    rows = predictions.select("item_id", "system", F.col("labels").cast("array<string>").alias("labels"), none.alias("gold")).unionByName(
        items.select("item_id", F.lit(None).cast("string").alias("system"), none.alias("labels"), F.col("gold").cast("array<string>").alias("gold"))
    )
    per_item = rows.groupBy("item_id").agg(
        F.count_if(F.col("system").isNull()).alias("in_items"), F.max("gold").alias("gold"),
        *[F.struct(
            F.count_if(F.col("system") == s).alias("n"), F.max(F.when(F.col("system") == s, F.col("labels"))).alias("labels")
        ).alias(f"s{i}") for i, s in enumerate(systems)],
    )
    answers = F.array(*[
        F.struct(F.lit(s).alias("system"), F.col(f"s{i}.n").alias("n"), F.col(f"s{i}.labels").alias("labels"))
        for i, s in enumerate(systems)
    ]) if systems else F.array().cast("array<struct<system:string,n:bigint,labels:array<string>>>")
    fault = F.when(
        (F.col("a.n") != 1) | (F.col("in_items") != 1),
        F.raise_error(F.concat_ws(
            " ", F.lit("length mismatch:"), "a.system", F.lit("has"), F.col("a.n").cast("string"), F.lit("answers for item"),
            F.coalesce(F.col("item_id").cast("string"), F.lit("NULL")), F.lit("listed"), F.col("in_items").cast("string"), F.lit("times"),
        )).cast("boolean"),
    )
    labels, gold = label_array(F.col("a.labels")), label_array(F.col("gold"))
    # A fault is part of every column that scores read, so column pruning keeps the check.
    return per_item.select("item_id", "in_items", "gold", F.explode(answers).alias("a")).select(
        F.when(fault.isNull(), F.col("a.system")).alias("system"), "item_id", labels.alias("labels"), gold.alias("gold"),
    ).withColumn("correct", F.col("labels") == F.col("gold"))


def tally(scored: DataFrame) -> DataFrame:
    """One pass to sufficient counts per system and label.

    Each item adds one row per label it involves and one row with a NULL label
    that carries the item itself, so accuracy and F1 need a single aggregation
    whose result has labels x systems rows.
    """
    label = F.explode(
        F.concat(F.array(F.lit(None).cast("string")), F.array_union("labels", "gold"))
    )
    rows = scored.select("system", "labels", "gold", "correct", label.alias("label"))
    predicted, actual = F.array_contains("labels", F.col("label")), F.array_contains("gold", F.col("label"))
    return rows.groupBy("system", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
    )


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 without a true positive, as precision or recall is then 0."""
    return F.when(tp == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn))


def label_counts(counts: DataFrame) -> DataFrame:
    """tp, fp, fn and F1 per system and label, from ``tally``."""
    return counts.filter(F.col("label").isNotNull()).select(
        "system", "label", "tp", "fp", "fn",
        f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
    )


def system_scores(counts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """n, number correct, accuracy and macro-F1 per system, from ``tally``.

    Macro-F1 runs over the union of predicted and gold labels, or over the given
    ``labels``; a label seen in neither is left out.
    """
    is_label = F.col("label").isNotNull()
    score = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    if labels is not None:
        wanted = broadcast_if_small(
            labels.select(F.col("label"), F.lit(True).alias("_wanted")).distinct()
        )
        counts = counts.join(wanted, "label", "left")
        is_label = is_label & F.col("_wanted")
    marker = F.col("label").isNull()
    return counts.groupBy("system").agg(
        F.coalesce(F.sum(F.when(marker, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(marker, F.col("n_correct"))), F.lit(0)).alias("n_correct"),
        F.avg(F.when(is_label, score)).alias("macro_f1"),
    ).select(
        "system", "n", "n_correct",
        F.try_divide(F.col("n_correct"), F.col("n")).alias("accuracy"),
        "macro_f1",
    )


def majority_floor(items: DataFrame) -> DataFrame:
    """Always predicting the most common label: one row, or none without any label.

    For a set-valued gold its smallest label votes. The earliest item breaks ties.
    Everything follows from counts per label, so no constant prediction is ever
    materialised.
    """
    gold = label_array(F.col("gold"))
    first = F.get(gold, F.lit(0))
    per_item = items.select("item_id", gold.alias("gold"), first.alias("vote"))
    votes = (
        per_item.select(
            "item_id", "vote", "gold",
            F.explode(F.concat(F.array(F.lit(None).cast("string")), "gold")).alias("label"),
        )
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("vote") == F.col("label")).alias("votes"),
            F.count_if((F.size("gold") == 1) & (F.col("vote") == F.col("label"))).alias("exact"),
            F.min(F.when(F.col("vote") == F.col("label"), F.col("item_id"))).alias("first_item"),
        )
    )
    is_label = F.col("label").isNotNull()
    best = F.struct(
        (-F.col("votes")).alias("fewest"), "first_item", "label", "votes",
        F.col("n").alias("tp"), "exact",
    )
    top = votes.agg(
        F.max(F.when(F.col("label").isNull(), F.col("n"))).alias("n"),
        F.count_if(is_label).alias("n_labels"),
        F.min(F.when(is_label & (F.col("votes") > 0), best)).alias("top"),
    ).filter(F.col("top").isNotNull())
    fp = F.col("n") - F.col("top.tp")
    return top.select(
        F.col("top.label").alias("label"),
        F.col("top.votes").alias("count"),
        "n",
        (F.col("top.exact") / F.col("n")).alias("accuracy"),
        (f1(F.col("top.tp"), fp, F.lit(0)) / F.col("n_labels")).alias("macro_f1"),
    )
