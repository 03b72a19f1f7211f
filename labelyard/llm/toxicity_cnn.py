"""Toxicity scores from a small convolutional text classifier, trained with numpy.

Words are hashed to embeddings, filters of several widths slide over them, each filter keeps its
largest response in the text, and a logistic layer weighs these. Training takes a bounded sample of
labelled rows on the driver; scoring is one pass over whole texts, and thresholds are calibrated on the
scores of all labelled rows that may be learned from and were not fitted. As a filter is a sum over the words
in its window, every word's part is computed once per model and scoring only adds table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from labelyard.llm.shingles import raw, word_hashes
from labelyard.llm.workers import batches_of_texts, per_worker, slices
from labelyard.sizing import materialise

BUCKET_BITS, DIMENSIONS, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
#: The most labelled rows of each class that training takes.
SAMPLE_ROWS = 3000
EPOCHS, RATE, LEAST_DOCUMENTS, SEED = 6, 0.1, 3, 5
#: Score bins for each unit of the logit, and the toxic rows a language needs for a threshold of its own.
BINS, LEAST_TOXIC = 64, 5


def _separators() -> np.ndarray:
    """Words are ASCII letters, digits and all bytes of other characters."""
    table = np.ones(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return table


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of every word of all texts, and where each text's words begin."""
    data, offsets = raw(texts)
    words, at = word_hashes(data, offsets, _separators())
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), at


@dataclass
class Model:
    """embedding[bucket, d]; filters[k] is [width, d, filter]; bias, weights and offset of the output."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width and place in the window, what each bucket adds to each filter."""
        return {k: [(self.embedding @ w).astype(np.float32) for w in self.filters[k]] for k in WIDTHS}

    def logits(self, words: np.ndarray, at: np.ndarray, tables: dict[int, list[np.ndarray]] | None = None) -> np.ndarray:
        """One number per text. A width that a text is too short for adds nothing."""
        tables = tables or self.tables()
        pooled = np.zeros((len(at) - 1, len(WIDTHS) * FILTERS), np.float32)
        for n, k in enumerate(WIDTHS):
            sizes = np.diff(at)
            some = np.flatnonzero(sizes >= k)
            if not len(some):
                continue
            total = len(words) - k + 1
            out = tables[k][0][words[:total]]
            for j in range(1, k):
                out = out + tables[k][j][words[j:total + j]]
            out = np.concatenate([out, np.full((1, FILTERS), -np.inf, np.float32)])
            ranges = np.stack([at[:-1][some], at[1:][some] - k + 1], axis=1).ravel()
            best = np.maximum.reduceat(out, ranges, axis=0)[::2]
            pooled[some, n * FILTERS:(n + 1) * FILTERS] = np.maximum(0, best + self.bias[n * FILTERS:(n + 1) * FILTERS])
        return pooled @ self.weights.astype(np.float32) + np.float32(self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """Embeddings begin with how much likelier a word is in texts of class 1, the rest is noise.

    A bucket seen in fewer than ``LEAST_DOCUMENTS`` texts is zero and stays so.
    """
    size = 1 << BUCKET_BITS
    seen = np.zeros((2, size))
    for words, label in zip(docs, labels):
        seen[int(label), np.unique(words)] += 1
    totals = np.maximum(1, np.array([(labels == 0).sum(), (labels == 1).sum()]))
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    often = seen.sum(axis=0) >= LEAST_DOCUMENTS
    embedding = np.where(often[:, None], rng.normal(0, 0.05, (size, DIMENSIONS)), 0.0)
    embedding[:, 0] = np.where(often, np.clip(odds, -2, 4) / 2, 0.0)
    filters = {k: rng.normal(0, 0.1, (k, DIMENSIONS, FILTERS)) for k in WIDTHS}
    for k in WIDTHS:
        filters[k][:, 0, :] = np.abs(rng.normal(0.6, 0.2, (k, FILTERS)))
    n = len(WIDTHS) * FILTERS
    return Model(embedding, filters, np.full(n, -0.3), np.abs(rng.normal(0.3, 0.1, n)), -1.0)


def _step(model: Model, words: np.ndarray, label: float, squares: dict) -> None:
    """One Adagrad step on one text. Each filter learns from the window of its largest response."""
    held, places = [], []
    for k in WIDTHS:
        total = len(words) - k + 1
        if total < 1:
            held.append(np.zeros(FILTERS))
            places.append(None)
            continue
        rows = model.embedding[words]
        out = rows[:total] @ model.filters[k][0]
        for j in range(1, k):
            out = out + rows[j:total + j] @ model.filters[k][j]
        places.append(out.argmax(axis=0))
        held.append(out.max(axis=0))
    act = np.concatenate(held) + model.bias
    pooled = np.maximum(0, act)
    pooled[[n * FILTERS + f for n, p in enumerate(places) if p is None for f in range(FILTERS)]] = 0
    error = float(sigmoid(np.array(pooled @ model.weights + model.offset)) - label)
    back = error * model.weights * (pooled > 0)

    def move(name: str, target: np.ndarray, grad: np.ndarray, index=...) -> None:
        squares[name][index] += grad * grad
        target[index] -= RATE * grad / np.sqrt(squares[name][index] + 1e-3)

    move("weights", model.weights, error * pooled)
    squares["offset"] += error * error
    model.offset -= RATE * error / np.sqrt(squares["offset"] + 1e-3)
    move("bias", model.bias, back)
    for n, (k, place) in enumerate(zip(WIDTHS, places)):
        g = back[n * FILTERS:(n + 1) * FILTERS]
        if place is None or not g.any():
            continue
        for j in range(k):
            at = words[place + j]
            rows, weights = model.embedding[at], model.filters[k][j].copy()
            move(("filters", k, j), model.filters[k][j], rows.T * g)
            grad = (weights * g).T
            live = rows.any(axis=1)
            for row, one in zip(at[live], grad[live]):
                move("embedding", model.embedding, one, row)


def train(texts: list[str], labels: np.ndarray, rate_of_ones: float) -> Model:
    """Fit on the texts that are not ``aside``, then set the offset for the true share of label 1."""
    rng = np.random.default_rng(SEED)
    held = pa.array(texts, pa.large_string())
    docs = []
    for start, n in slices(held, 4 << 20):  # hashing keeps tables of the size of a slice
        some, places = buckets(held.slice(start, n))
        docs += [some[a:b] for a, b in zip(places[:-1], places[1:])]
    fit = np.flatnonzero(~aside(len(docs)))
    model = _start([docs[i] for i in fit], labels[fit], rng)
    squares: dict = {name: np.zeros_like(getattr(model, name)) for name in ("weights", "bias", "embedding")}
    squares["offset"] = 0.0
    squares.update({("filters", k, j): np.zeros((DIMENSIONS, FILTERS)) for k in WIDTHS for j in range(k)})
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            _step(model, docs[i], float(labels[i]), squares)
    share = min(0.99, max(0.01, labels.mean())) if len(labels) else 0.5
    rate = min(0.99, max(0.001, rate_of_ones))
    model.offset += float(np.log(rate / (1 - rate)) - np.log(share / (1 - share)))
    return model


def aside(n: int) -> np.ndarray:
    """Every fifth of n texts is not fitted, so that a small table has rows for calibration."""
    return np.arange(n) % 5 == 4


def _best_threshold(bins: dict[int, np.ndarray], totals: np.ndarray) -> float:
    """The lower edge of the score bin with the best F1 if texts from it on count as toxic; 0.5 without any.

    ``bins`` has how many rows of each label were calibrated on, ``totals`` how many there are.
    """
    order = sorted(bins, reverse=True)
    counts = np.array([bins[b] for b in order], np.float64).reshape(-1, 2)
    held = counts.sum(axis=0)
    if not held[1]:
        return 0.5
    counts *= totals / np.maximum(1, held)
    hit = np.cumsum(counts[:, 1])
    f1 = 2 * hit / (np.cumsum(counts.sum(axis=1)) + counts[:, 1].sum() + 1e-12)
    return float(sigmoid(np.float64(order[int(f1.argmax())] / BINS)))


def calibrated(scored: DataFrame, used: DataFrame, fitted: DataFrame) -> dict[str, float]:
    """For each language, and "" for all, the score that gives the best F1 on the labelled rows not fitted.

    ``scored`` has doc_id, lang and score, ``used`` the labels that may be learned from, ``fitted`` the doc_id of
    rows that were. A language with fewer than ``LEAST_TOXIC`` toxic rows takes the common threshold.
    """
    known = used.select("doc_id", F.col("toxic").cast("int").alias("toxic")).join(F.broadcast(fitted.withColumn("_fit", F.lit(True))), "doc_id", "left")
    logit = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * BINS).cast("int")
    counted = (
        scored.join(known, "doc_id")
        .groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", F.when(F.col("_fit").isNull(), logit).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins: dict[str, dict[int, np.ndarray]] = {"": {}}
    totals: dict[str, np.ndarray] = {"": np.zeros(2)}
    for row in counted.toLocalIterator():  # a few thousand numbers for each language at most
        for lang in {"", row["lang"]}:
            totals.setdefault(lang, np.zeros(2))[row["toxic"]] += row["n"]
            if row["bin"] is not None:
                bins.setdefault(lang, {}).setdefault(row["bin"], np.zeros(2))[row["toxic"]] += row["n"]
    return {
        lang: _best_threshold(held, totals[lang]) for lang, held in bins.items()
        if not lang or sum(n[1] for n in held.values()) >= LEAST_TOXIC
    }


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


class OneClass(ValueError):
    """There are no labelled rows of both classes; ``prior`` is the share of ones, 0 without any label."""

    def __init__(self, prior: float):
        super().__init__("training needs labelled rows of both classes")
        self.prior = prior


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows of each class, the first by a hash of the id; calibrate on all others."""
    return _fitted(docs, labels, rows)[0]


def _fitted(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[Model, DataFrame]:
    """The model, and doc_id, lang and score of every row."""
    used = labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["n"] for r in used.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = used.filter(F.col("toxic") == label).select("doc_id", "toxic", F.md5(F.col("doc_id").cast("string")).alias("_order"))
        part = part.orderBy("_order", "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
        .orderBy("_order", "text").limit(4 * rows).toPandas()
    )
    if sample.empty or sample["toxic"].nunique() < 2:
        raise OneClass(counts.get(1, 0) / max(1, sum(counts.values())))
    total = sum(counts.values())
    model = train(list(sample["text"]), sample["toxic"].to_numpy(np.float64), counts.get(1, 0) / total)
    scored = materialise(score(docs, model, ["doc_id", "lang"]), "toxicity-scores")
    ids = docs.sparkSession.createDataFrame([(x,) for x in set(sample["doc_id"][~aside(len(sample))].tolist())], docs.select("doc_id").schema)
    model.thresholds = calibrated(scored, used, ids)
    return model, scored


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id) and score, from the text alone; a null text counts as empty."""
    columns = columns or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    key = xxhash.xxh3_64_hexdigest(model.embedding.tobytes() + model.weights.tobytes())
    at_text = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        tables = per_worker(("toxicity", key), own.tables)
        for batch in batches:
            for some in batches_of_texts(batch, at_text):
                scores = sigmoid(own.logits(*buckets(some.column(at_text)), tables).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(at_text)], pa.array(scores)], [*columns, "score"])

    source = docs.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, schema + ", score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, held_out, score, predicted (score of 0.7 or more) and by_language of every row.

    by_language compares the score with the threshold calibrated for the row's language. Empty and
    null texts have the score of a text without words, rows are scored one by one, equal texts alike,
    and a null id is not held out. Without labelled rows of both classes every score is the share of ones among the
    labels, 0 without any; an empty table gives no rows.
    """
    try:
        model, scored = _fitted(docs, labels, SAMPLE_ROWS)
    except OneClass as found:
        prior = F.lit(float(found.prior))
        sure = F.when(prior >= 0.7, 1).otherwise(0)
        return docs.select("doc_id", "lang", held_out().alias("held_out"), prior.alias("score"), sure.alias("predicted"), sure.alias("by_language"))
    limits = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
    limit = F.coalesce(F.try_element_at(limits, F.coalesce(F.col("lang"), F.lit(""))), F.lit(model.thresholds[""]))
    return scored.select(
        "doc_id", "lang", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.when(F.col("score") >= limit, 1).otherwise(0).alias("by_language"),
    )
