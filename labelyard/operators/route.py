"""Zero-shot routing: texts against label schemas that are supplied as rows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, tokens
from .schema import Head, collect_heads


def split_blank(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Usable rows, and rejected rows with a reason."""
    blank = is_blank(F.col(text))
    return df.filter(~blank), df.filter(blank).withColumn("reason", F.lit("text is empty"))


def label_words(head: Head) -> list[tuple[str, list[str]]]:
    """Words that speak for each label: its description, or else its name."""
    out = []
    for label in head.labels:
        text = (head.described or {}).get(label) or re.sub(r"[_\-]+", " ", label)
        words = [w for w in re.findall(r"\w\w+", text.lower())]
        out.append((label, sorted(set(words))))
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(value: list, ddl: str) -> Column:
    """A nested constant; the optimiser folds it before anything runs."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{ddl}>")["v"]


def _hits(text: Column, words: list[list[str]]) -> Column:
    """Sorted indexes of the labels that the words of ``text`` speak for, one per occurrence.

    The vocabulary is a constant hash table, so a word costs one look-up whatever the
    number of labels.
    """
    speaks: dict[str, list[int]] = {}
    for index, own in enumerate(words):
        for word in own:
            speaks.setdefault(word, []).append(index)
    size = 1 << max(1, len(speaks)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for word, indexes in speaks.items():
        buckets[zlib.crc32(word.encode()) % size].append({"w": word, "i": indexes})
    table = _literal(buckets, "array<array<struct<w:string,i:array<int>>>>")

    def look_up(word: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(F.encode(word, "utf-8")), F.lit(size)).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["w"] == word), lambda e: e["i"]))

    found = F.flatten(F.transform(tokens(text), look_up))
    return F.sort_array(F.coalesce(found, F.array().cast("array<int>")))


def _between(hits: Column, first: int, last: int) -> Column:
    return F.filter(hits, lambda h: (h >= first) & (h < last))


def _scored(hits: Column, first: int, names: Column) -> Column:
    """``array<struct<score, rank, label>>`` of the labels in ``hits`` (sorted), rank = -position."""

    def runs(hits: Column) -> Column:
        starts = F.filter(
            F.transform(hits, lambda h, i: F.when((i == 0) | (F.get(hits, i - 1) != h), i)),
            lambda i: i.isNotNull(),
        )

        def scores(starts: Column) -> Column:
            def score(start: Column, i: Column) -> Column:
                position = F.get(hits, start) - F.lit(first)
                end = F.coalesce(F.get(starts, i + 1), F.size(hits))
                return F.struct(
                    (end - start).cast("long").alias("score"), (-position).alias("rank"),
                    F.get(names, position).alias("label"),
                )

            return F.transform(starts, score)

        return _let(starts, scores)

    return _let(hits, runs)


def _answer(scored: Column, head: Head, names: Column) -> Column:
    """Labels and confidence from the scores above 0.

    A single-label head answers with the best score, ties going to the earlier
    label, and with its first label when nothing matched. A multi-label head answers with
    every label whose share reaches the threshold, none when nothing matched. Confidence is
    the (smallest kept) share, NULL when nothing matched.
    """

    def answer(scored: Column) -> Column:
        total = F.aggregate(scored, F.lit(0).cast("long"), lambda acc, s: acc + s["score"])

        def shares(total: Column) -> Column:
            matched = total > 0
            if not head.multi_label:
                best = F.array_max(scored)
                return F.struct(
                    F.array(F.coalesce(best["label"], F.lit(head.labels[0]))).alias("labels"),
                    F.when(matched, best["score"] / total).alias("confidence"),
                )
            if head.cls_threshold <= 0:  # labels without a match reach the threshold, too
                least = F.when(F.size(scored) == len(head.labels), F.array_min(F.transform(scored, lambda s: s["score"])))
                return F.struct(
                    F.when(matched, F.array_sort(names)).otherwise(F.array().cast("array<string>")).alias("labels"),
                    F.when(matched, F.coalesce(least, F.lit(0)) / total).alias("confidence"),
                )
            kept = F.filter(scored, lambda s: s["score"] / total >= float(head.cls_threshold))
            return F.struct(
                F.array_sort(F.transform(kept, lambda s: s["label"])).alias("labels"),
                (F.array_min(F.transform(kept, lambda s: s["score"])) / total).alias("confidence"),
            )

        return _let(total, shares)

    return _let(scored, answer)


def route(items: DataFrame, schema: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Label every text for every head of ``schema``, one row per text and head.

    The score of a label is the number of words of the text that belong to it. The plan is a
    projection without a shuffle for a schema of any width, on tables and on streams. A NULL
    or blank text matches nothing; rows with equal ids are answered one by one.
    """
    heads = collect_heads(schema)
    keep = keep or ["item_id"]
    words = [(name, ws) for name, head in heads.items() for _, ws in label_words(head)]
    hits = _hits(F.col("text"), [ws for _, ws in words])

    def answers(hits: Column) -> Column:
        rows, first = [], 0
        for name, head in heads.items():
            names, last = _literal(list(head.labels), "array<string>"), first + len(head.labels)
            own = _between(hits, first, last) if len(heads) > 1 else hits
            rows.append(F.struct(
                F.lit(name).alias("head"), _answer(_scored(own, first, names), head, names).alias("a")
            ))
            first = last
        return F.array(*rows)

    return items.select(*keep, F.explode(_let(hits, answers)).alias("h")).select(
        *keep, "h.head", "h.a.labels", "h.a.confidence"
    )
