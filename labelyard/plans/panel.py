"""The evidence panel: every system on the same items, a floor, and paired tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, functions as F

from ..functions.replies import reply_record
from ..operators.arms import classify_many, lexical_scorer, predictions_of
from ..operators.labels import description_coverage
from ..operators.sampling import first_n
from ..operators.schema import build_schema, inflation_note
from ..operators.scoring import (
    majority_floor, score_items, system_scores, tally,
)
from ..operators.stats import bootstrap_ci, compare_pairs, pair_cells
from ..operators.supervised import MAX_CLASSES, MAX_ITER, build_arm, timed_predictions
from ..operators.usage import (
    cost_per_1k, latency_percentiles, reply_notes, reply_quality, timing_note, with_unusable,
)
from ..sizing import broadcast_if_small, materialise, take_bounded
from ..sources.cache import cached_predictions, load_or_fit, training_fingerprint
from ..types import MAX_SYSTEMS, PANEL_COLUMNS, UNAVAILABLE

# Fixed value: the description of the metric that goes with every panel.
METRIC = (
    "exact-set match (a prediction is correct only if the label set equals the reference)"
)
# Texts of the panel's notes.
FLOOR_NAME = "majority class (%s)"
FLOOR_NOTES = ["floor, not a system: predicts '%s' for everything (%d/%d items)", "a model must beat this to be doing anything"]
ZERO_SHOT_NOTE = "zero-shot, 0 training examples"
TRAINED_NOTE = "trained on {:,} labelled examples"
TAXONOMY_NOTE = "{}-way fixed taxonomy"
NO_DESCRIPTIONS = "{} ships no label descriptions (coverage {:.0%})"

# A supervised arm answers a slice in so many parts, each with a time of its own.
TIMED_PARTS = 4
ZERO_SHOT, SUPERVISED, EXTERNAL = "zero_shot", "supervised", "external"

# Requestable systems: display name and role.
SYSTEMS = {
    "zero_shot": ("Word overlap (zero-shot)", ZERO_SHOT),
    "zero_shot_described": ("Word overlap + label descriptions", ZERO_SHOT),
    "tfidf": ("TF-IDF + logistic regression", SUPERVISED),
    "embedding": ("Embeddings + logistic regression", SUPERVISED),
    "closed": ("Fixed-taxonomy classifier (supervised)", SUPERVISED),
    "external": ("External model (zero-shot)", EXTERNAL),
}


@dataclass
class Panel:
    """Result tables of one panel run; each can be written as it is."""

    fixture: DataFrame
    systems: DataFrame
    comparisons: DataFrame
    unavailable: DataFrame
    notes: DataFrame
    metric: str = METRIC

    def write(self, path: str, format: str = "parquet") -> None:
        for name in ("fixture", "systems", "comparisons", "unavailable", "notes"):
            getattr(self, name).write.mode("overwrite").format(format).save(f"{path}/{name}")


class Unavailable(Exception):
    """A system that cannot be asked, as something it needs was not given; not one that fails."""


def system_rows(scored: DataFrame, *, method: str = "exact") -> DataFrame:
    """n, accuracy with interval and macro-F1 of every system in one pass over items."""
    ci = bootstrap_ci(F.col("n"), F.col("n_correct"), method=method)
    return system_scores(tally(scored)).withColumn("ci", ci).select(
        F.col("system").alias("name"), "n", "accuracy", "ci.ci_low", "ci.ci_high", "macro_f1"
    )


def floor_row(items: DataFrame) -> DataFrame:
    """The majority-class row: a reference point, never part of a paired test."""
    label = F.col("label")
    return majority_floor(items).select(
        F.format_string(FLOOR_NAME, label).alias("name"),
        "n", "accuracy",
        F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"),
        "macro_f1",
        F.lit(None).cast("double").alias("p50_ms"), F.lit(None).cast("double").alias("p95_ms"),
        F.lit(None).cast("double").alias("cost_per_1k_usd"), F.lit("free").alias("cost_status"),
        F.array(F.format_string(FLOOR_NOTES[0], label, "count", "n"), F.lit(FLOOR_NOTES[1])).alias("notes"),
    )


def pairing(roles: dict[str, str], sizes: dict[str, int]) -> list[tuple[str, str]]:
    """Zero-shot systems against all others that were scored on equally many items."""
    ours = [s for s in roles if roles[s] == ZERO_SHOT]
    others = [s for s in roles if roles[s] != ZERO_SHOT]
    return [
        (a, b) for b in others for a in ours
        if a in sizes and b in sizes and sizes[a] == sizes[b]
    ]


def score_panel(
    items: DataFrame,
    predictions: DataFrame,
    roles: dict[str, str],
    *,
    limit: int | None = None,
    labels: DataFrame | None = None,
    name: str = "",
    note: str = "",
    costs: DataFrame | None = None,
    notes: DataFrame | None = None,
    run_notes: Sequence[str] = (),
    unavailable: Sequence[tuple[str, str]] = (),
    method: str = "exact",
) -> Panel:
    """Score prediction tables of any systems on one slice of ``items``.

    ``predictions`` carries ``system, item_id, labels`` and optionally
    ``latency_ms``. Every system must answer exactly the items of the slice.
    Item-level work is two scans (scores, paired tests); only rows per system and
    label reach the statistics.
    """
    spark = items.sparkSession
    sliced = first_n(items, limit)
    if limit:
        sliced = materialise(sliced.select("item_id", "gold"), "slice")
        predictions = predictions.join(
            broadcast_if_small(sliced.select("item_id")), "item_id", "left_semi"
        )
    predictions = predictions.filter(F.col("system").isin(*roles))
    try:  # stored, as it is read for the scores and again for the paired tests
        scored = materialise(score_items(predictions, sliced), "scored")
    except SparkRuntimeException as error:
        if "length mismatch" in str(error):
            raise ValueError(str(error)) from error
        raise
    base = take_bounded(system_rows(scored, method=method), MAX_SYSTEMS, "list of systems")
    sizes = {r["name"]: r["n"] for r in base}
    rows = spark.createDataFrame(
        [tuple(r) for r in base],
        "name string, n long, accuracy double, ci_low double, ci_high double, macro_f1 double",
    )

    def attach(table: DataFrame | None, columns: str) -> DataFrame:
        if table is None:
            return spark.createDataFrame([], f"name string, {columns}")
        return table.withColumnRenamed("system", "name").select(
            "name", *[c.split()[0] for c in columns.split(", ")]
        )

    latency = None
    if "latency_ms" in predictions.columns:
        latency = latency_percentiles(predictions)
    rows = (
        rows.join(attach(latency, "p50_ms double, p95_ms double"), "name", "left")
        .join(attach(costs, "cost_per_1k_usd double, cost_status string"), "name", "left")
        .join(attach(notes, "notes array<string>"), "name", "left")
        .withColumn("cost_status", F.coalesce("cost_status", F.lit("free")))
        .withColumn(
            "notes",
            F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda x: x != ""),
        )
    )
    systems = rows.select(*PANEL_COLUMNS).unionByName(floor_row(sliced).select(*PANEL_COLUMNS))
    cells = pair_cells(scored.select("system", "item_id", "correct"), pairing(roles, sizes))
    n_items = max(sizes.values(), default=0)
    if labels is None:
        labels = items.select(F.explode("gold").alias("label")).distinct()
    if "description" not in labels.columns:
        labels = labels.withColumn("description", F.lit(None).cast("string"))
    fixture = description_coverage(labels).select(
        F.lit(name).alias("name"), F.lit(n_items).cast("long").alias("n_items"), "n_labels",
        F.col("coverage").alias("label_coverage"), F.lit(note).alias("note"),
    )
    return Panel(
        fixture, systems, compare_pairs(cells, method=method),
        spark.createDataFrame(list(unavailable), UNAVAILABLE),
        spark.createDataFrame([(n,) for n in run_notes], "note string"),
    )


def run_arms(
    arms: dict[str, Callable[[], DataFrame]]
) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Run each arm to a table; one that is ``Unavailable`` becomes a reason, one that fails ends the run."""
    done, failed = {}, []
    for system, arm in arms.items():
        try:
            done[system] = materialise(arm(), "predictions")
        except Unavailable as exc:
            failed.append((system, str(exc)))
    return done, failed


def given_train(train: DataFrame | Callable[[], DataFrame] | None, name: str = "") -> DataFrame:
    """The training rows; where there is no such file, or no way to get them, ``Unavailable`` with the reason."""
    if train is None:
        raise Unavailable(f"no train split for {name}")
    try:
        return train() if callable(train) else train
    except FileNotFoundError as exc:
        raise Unavailable(str(exc)) from exc


def run_panel(
    items: DataFrame,
    labels: DataFrame,
    *,
    systems: Sequence[str] = ("zero_shot",),
    described: bool = False,
    limit: int | None = 500,
    train: Callable[[], DataFrame] | None = None,
    replies: DataFrame | None = None,
    concurrency: int = 4,
    input_per_mtok: float = 0.0,
    output_per_mtok: float = 0.0,
    name: str = "",
    note: str = "",
    method: str = "exact",
    cache: str | None = None,
    num_features: int | None = None,
    max_iter: int = MAX_ITER,
) -> Panel:
    """Run the requested systems on one slice and score them.

    ``items`` has ``item_id, text, gold`` (and ``embedding`` for that arm),
    ``labels`` has ``label, ord[, description]``. ``train`` returns the training
    rows, or raises ``FileNotFoundError`` where there are none; any other failure of an arm ends the run. ``replies`` are the answers of an
    external model, ``item_id, content, latency_ms, prompt_tokens,
    completion_tokens, error``. Every arm is timed: zero-shot ones by chunks of calls,
    supervised ones by parts of the slice. With ``cache``, a folder, answers and fitted arms are kept there;
    a later run scores only items, texts, labels or training rows that it has not seen.
    ``num_features`` and ``max_iter`` go to the supervised text arms.
    """
    unknown = [s for s in systems if s not in SYSTEMS]
    if unknown:
        raise ValueError(f"unknown systems: {unknown}")
    spark = items.sparkSession
    sliced = first_n(items, limit)
    if limit:
        sliced = materialise(sliced, "slice")
    coverage = description_coverage(labels).first()["coverage"] if "description" in labels.columns else 0.0
    arms: dict[str, Callable[[], DataFrame]] = {}
    unavailable: list[tuple[str, str]] = []
    notes: list[tuple[str, list[str]]] = []
    run_notes: list[str] = []
    costs = reply_note_rows = None

    def zero_shot(use_descriptions: bool) -> tuple[Callable[[], DataFrame], list[str]]:
        schema = build_schema(labels, described=use_descriptions)
        row = inflation_note(schema).first()
        text = [row["note"], ZERO_SHOT_NOTE, row["warning"] or ""]

        def answer(part: DataFrame) -> DataFrame:
            return predictions_of(classify_many(part, schema, lexical_scorer, system="zero_shot")).drop("system")

        def arm() -> DataFrame:
            if cache is None:
                return answer(sliced).select("item_id", "labels", "latency_ms")
            known = cached_predictions(sliced, schema, answer, system="zero_shot", path=f"{cache}/predictions")
            return known.select("item_id", "labels", "latency_ms")

        return arm, text

    for key in systems:
        title, role = SYSTEMS[key]
        if key == "zero_shot_described" and not coverage > 0:
            unavailable.append(
                (title, NO_DESCRIPTIONS.format(name, coverage))
            )
        elif role == ZERO_SHOT:
            arms[title], text = zero_shot(described or key == "zero_shot_described")
            notes.append((title, text))
        elif role == SUPERVISED:
            def supervised(key: str = key, title: str = title) -> DataFrame:
                rows = given_train(train, name)
                if cache is None:
                    arm = build_arm(key, rows, num_features=num_features, max_iter=max_iter)
                else:
                    named = f"{key}-{num_features}-{max_iter}-{training_fingerprint(rows)}"
                    arm = load_or_fit(spark, key, rows, f"{cache}/arms/{named}", num_features=num_features, max_iter=max_iter)
                notes.append((title, [
                    TRAINED_NOTE.format(arm.trained_on), TAXONOMY_NOTE.format(len(arm.labels)),
                ]))

                def answer(part: DataFrame) -> DataFrame:
                    return timed_predictions(arm, part, title, parts=TIMED_PARTS).drop("system").withColumn("head", F.lit("label"))

                if cache is None:
                    return answer(sliced).select("item_id", "labels", "latency_ms")
                # an answer on vectors depends on them rather than on the text
                keyed = sliced.withColumn("text", F.to_json(F.struct("embedding"))) if key == "embedding" else sliced
                known = cached_predictions(keyed, None, answer, system=key, path=f"{cache}/predictions", fingerprint=named)
                return known.select("item_id", "labels", "latency_ms")

            arms[title] = supervised
        elif replies is None:
            unavailable.append((title, "no replies table given for the external model"))
        else:
            names = [
                r["label"] for r in take_bounded(
                    labels.select("label", "ord").orderBy("ord"), MAX_CLASSES, "label set"
                )
            ]
            record = reply_record(F.col("content"), names)
            parsed = materialise(
                replies.join(broadcast_if_small(sliced.select("item_id")), "item_id", "left_semi")
                .withColumn("r", record)
                .select(
                    F.lit(title).alias("system"), "item_id", "r.label", "latency_ms",
                    "prompt_tokens", "completion_tokens",
                    F.coalesce("error", "r.error").alias("error"),
                ),
                "replies",
            )
            costs = cost_per_1k(
                parsed, input_per_mtok=input_per_mtok, output_per_mtok=output_per_mtok
            )
            reply_note_rows = reply_notes(reply_quality(parsed), costs)
            run_notes += [r["note"] for r in timing_note(parsed, concurrency).collect()]
            arms[title] = lambda: with_unusable(parsed).select("item_id", "labels", "latency_ms")

    done, failed = run_arms(arms)
    unavailable += failed
    if not done:
        predictions = spark.createDataFrame(
            [], f"system string, item_id {items.schema['item_id'].dataType.simpleString()}, "
            "labels array<string>, latency_ms double"
        )
    else:
        predictions = None
        for title, table in done.items():
            part = table.select(F.lit(title).alias("system"), *table.columns)
            predictions = part if predictions is None else predictions.unionByName(
                part, allowMissingColumns=True
            )
    note_rows = spark.createDataFrame(
        [(s, [t for t in ts if t]) for s, ts in notes], "system string, notes array<string>"
    )
    if reply_note_rows is not None:
        note_rows = note_rows.unionByName(reply_note_rows)
    roles = {SYSTEMS[k][0]: SYSTEMS[k][1] for k in systems if SYSTEMS[k][0] in done}
    return score_panel(
        sliced, predictions, roles, labels=labels, name=name, note=note, costs=costs,
        notes=note_rows, run_notes=run_notes, unavailable=unavailable, method=method,
    )
