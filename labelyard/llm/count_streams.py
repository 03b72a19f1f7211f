"""Phrase collocations from sorted streams of counts.

Three passes over the texts count words, then pairs of frequent words, then windows of up to five
words whose pairs are all frequent; a phrase cannot be frequent if a part of it is not. Bloom filters
of bounded size tell what may be frequent, so a pass ships little; what they let through is counted
exactly, and a fuller filter only ships more. Windows are sorted, and one stack over the sorted stream
sums all their beginnings. The frequent phrases are then read twice as sorted streams, in prefix and
in suffix order: in the first, the beginnings of a phrase stand before it and its extensions to the
right behind it; in the second, its endings and its extensions to the left. Counts for a cut and for an
extension are met in lockstep with the stream, from a stack of at most five, without a hash table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from labelyard.llm.shingles import byte_hashes, mixed
from labelyard.llm.workers import batches_of_texts
from labelyard.sizing import materialise

#: Bytes between words, and bytes that end a piece.
BLANK, BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
#: Bytes of text that are counted at once; a longer piece is counted whole.
SLICE = 1 << 20
#: Bits for each frequent word or pair, look-ups, least and largest filter, and the stretch one task builds.
BITS_PER_KEY, PROBES, LARGEST_BITS, STRETCH_BITS = 16, 3, 1 << 28, 1 << 16
PHRASE = "lang string, words array<string>, a long"


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to 5 words found at least ``least`` times; ``top`` of each language are returned."""

    least: int = 100
    top: int = 2000


class Words:
    """The words of a stretch of text: normalised bytes (joined by one space), where each starts and stops, hashes, pieces."""

    def __init__(self, data: bytes, lang: str):
        raw = np.frombuffer(data, np.uint8)
        kind = np.zeros(256, np.uint8)
        kind[list(BLANK)], kind[list(BREAK)] = 1, 2
        lowered = np.arange(256, dtype=np.uint8)
        lowered[65:91] += 32
        kinds = kind[raw]
        solid = np.concatenate([[False], kinds == 0, [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, stops = edges[::2], edges[1::2]
        sizes = stops - starts + 1
        self.stops = np.cumsum(sizes) - 1
        self.starts = self.stops - sizes + 1
        at = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - self.starts, sizes)
        text = lowered[np.append(raw, np.uint8(32))[at]] if len(at) else np.zeros(0, np.uint8)
        text[self.stops] = 32
        self.text = text
        self.piece = np.cumsum(kinds == 2, dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
        salt = mixed(np.frombuffer(lang.encode().ljust(8, b"\0")[:8], "<u8") + np.uint64(len(lang)))
        self.hashes = mixed(byte_hashes(text, self.starts, self.stops) + salt) if len(starts) else np.zeros(0, np.uint64)

    def gathered(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """Space-joined words from ``first`` to ``last``, both included, as strings."""
        starts, stops = self.starts[first], self.stops[last]
        sizes = stops - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(int(offsets[-1]), dtype=np.int64) + np.repeat(starts - offsets[:-1], sizes)
        return pa.Array.from_buffers(
            pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.text[at]))]
        )

    def pairs(self) -> np.ndarray:
        """For each word but the last the hash of it and the next one."""
        return mixed(self.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:])


def stretches(texts: list[str | None], most: int) -> Iterator[bytes]:
    """The texts, joined by newlines, in stretches of about ``most`` bytes that end where a piece ends."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        while size + len(data) > most:
            room = max(0, most - size)
            cut = max(data.rfind(bytes([b]), 0, room) for b in BREAK) + 1
            if not cut and not held:
                found = [x for x in (data.find(bytes([b]), room) for b in BREAK) if x >= 0]
                cut = min(found) + 1 if found else len(data)
            yield b"\n".join([*held, data[:cut]])
            held, size, data = [], 0, data[cut:]
        held.append(data)
        size += len(data) + 1
    if size:
        yield b"\n".join(held)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, a column per probe."""
    step = mixed(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)], axis=1)


def known(filter_bytes: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    if not len(hashes):
        return np.zeros(0, bool)
    held = np.frombuffer(filter_bytes, np.uint8)
    at = positions(hashes, 8 * len(held))
    return ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def bloom(phrases: DataFrame, order: int) -> bytes:
    """The filter of all phrases (lang, phrase), each of ``order`` words (1 or 2); built in stretches, at most 32 MB."""
    n = phrases.count()
    bits = min(LARGEST_BITS, max(STRETCH_BITS, 1 << max(1, n * BITS_PER_KEY).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs.tolist())):
                held = Words("\n".join(batch.column(1).take(pa.array(np.flatnonzero(langs == lang))).to_pylist()).encode("utf-8", "surrogatepass"), lang)
                hashes.append(held.hashes if order == 1 else held.pairs()[::2])
            at = np.unique(positions(np.concatenate(hashes), bits)) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // np.uint64(STRETCH_BITS)).astype(np.int32)), pa.array((at % np.uint64(STRETCH_BITS)).astype(np.int32))], ["stretch", "spot"]
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            stretch, spot = (batch.column(i).to_numpy() for i in range(2))
            for number in np.unique(stretch).tolist():
                held.setdefault(number, np.zeros(STRETCH_BITS, bool))[spot[stretch == number]] = True
        for number, marks in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["stretch", "bits"]
            )

    parts = phrases.select("lang", "phrase").mapInArrow(spots, "stretch int, spot int").repartition("stretch").mapInArrow(packed, "stretch int, bits binary")
    whole = bytearray(bits // 8)
    for row in parts.toLocalIterator():
        start = row["stretch"] * (STRETCH_BITS // 8)
        whole[start:start + STRETCH_BITS // 8] = row["bits"]
    return bytes(whole)


def counted(docs: DataFrame, order: int, words: Broadcast | None = None, pairs: Broadcast | None = None) -> DataFrame:
    """lang, phrase, n: occurrences of words (order 1), pairs of known words (2) or windows (3) in all texts.

    A window starts at each word and runs over up to five words of its piece whose neighbours are
    all known pairs; those of fewer than three words say nothing new.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for some in batches_of_texts(batch, 1, SLICE):
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    held.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text or "") + 1
                    if sizes[lang] >= SLICE:
                        sizes.pop(lang)
                        yield from counts(lang, held.pop(lang))
                if sum(sizes.values()) >= 4 * SLICE:  # many languages
                    sizes.clear()
                    for lang in [*held]:
                        yield from counts(lang, held.pop(lang))
        for lang in [*held]:
            yield from counts(lang, held.pop(lang))

    def counts(lang: str, texts: list) -> Iterator[pa.RecordBatch]:
        for stretch in stretches(texts, SLICE):
            whole = Words(stretch, lang)
            first, last = chosen(whole)
            if len(first):
                found = pc.value_counts(whole.gathered(first, last))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), found.field(0).cast(pa.string()), found.field(1)], ["lang", "phrase", "n"]
                )
        pa.default_memory_pool().release_unused()

    def chosen(held: Words) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(held.starts))
        if order == 1:
            return every, every
        joined = held.piece[1:] == held.piece[:-1]
        if order == 2:
            may = known(words.value, held.hashes)
            first = np.flatnonzero(joined & may[1:] & may[:-1])
            return first, first + 1
        at = np.flatnonzero(joined)
        joined[at] = known(pairs.value, held.pairs()[at])
        reach = np.zeros(len(every), np.int64)  # how many known pairs follow each other from here, four at most
        for _ in range(LONGEST - 1):
            reach[:-1] = np.where(joined, np.minimum(reach[1:] + 1, LONGEST - 1), 0)
        first = np.flatnonzero(reach >= 2)
        return first, first + reach[first]

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    rows = source.mapInArrow(count, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def beginnings(windows: DataFrame, least: int) -> DataFrame:
    """Phrases of three to five words that begin at least ``least`` windows, from the sorted stream of windows.

    All windows with the same three first words are in one task, and the stack has one sum for each
    length of the window before.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, stack, sums = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for now, words, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                same = 0
                if now == lang:
                    while same < min(len(stack), len(words)) and stack[same] == words[same]:
                        same += 1
                out += [(lang, stack[:k], sums[k]) for k in range(max(3, same + 1), len(stack) + 1) if sums[k] >= least]
                lang, stack = now, words
                sums = [sums[k] + n if k <= same and k < len(sums) else n for k in range(len(words) + 1)]
            yield _phrases(out)
        yield _phrases([(lang, stack[:k], sums[k]) for k in range(3, len(stack) + 1) if sums[k] >= least])

    rows = windows.select("lang", F.split("phrase", " ").alias("words"), "n")
    dealt = rows.repartition("lang", *(F.col("words")[i] for i in range(3))).sortWithinPartitions("lang", "words")
    return dealt.mapInArrow(read, PHRASE)


def _phrases(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.int64()))], ["lang", "words", "a"]
    )


STREAM = "lang string, words array<string>, a long, outer long, carried array<long>, inner array<long>, extended long"


def in_lockstep(phrases: DataFrame) -> DataFrame:
    """Read phrases as a stream sorted by ``words`` and add, from the stack of those they begin with:

    ``inner``, the counts of their beginnings of 1, 2, ... words but the last, and ``extended``, the
    largest count of a phrase one word longer that begins with them (0 without one). ``outer`` is the
    count of the first word, which pairs bring along. Phrases with the same two first words are in one task.
    """
    names = [c.split()[0] for c in STREAM.split(", ")]
    kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        for batch in batches:
            out: list[list] = []
            for lang, words, a, outer, carried in zip(*(batch.column(i).to_pylist() for i in range(5))):
                while stack and (stack[-1][0] != lang or words[:len(stack[-1][1])] != stack[-1][1]):
                    out.append(stack.pop())
                if stack:
                    stack[-1][6] = max(stack[-1][6], a)
                inner = [*stack[-1][5], stack[-1][2]] if stack else [outer]
                stack.append([lang, words, a, outer, carried, inner, 0])
            yield batch_of(out)
        yield batch_of(stack[::-1])

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    dealt = phrases.repartition("lang", F.col("words")[0], F.col("words")[1]).sortWithinPartitions("lang", "words")
    return dealt.select("lang", "words", "a", "outer", "carried").mapInArrow(read, STREAM)


def scored(phrases: DataFrame) -> DataFrame:
    """Add l, r and score at the lowest-scoring cut, with whole numbers of any size.

    ``lefts`` are the counts of the first 1, 2, ... words, ``rights`` those of the last 1, 2, ... words.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, n, lefts, rights in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "n", "lefts", "rights"))):
                cuts = [(1000 * a * n // (left * right), k, left, right) for k, (left, right) in enumerate(zip(lefts, reversed(rights)))]
                score, _, left, right = min(cuts)
                out.append((left, right, score))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("lang", "phrase", "a", "n")), *(pa.array(list(c), pa.int64()) for c in columns)],
                ["lang", "phrase", "a", "n", "l", "r", "score"],
            )

    return phrases.mapInArrow(read, "lang string, phrase string, a long, n long, l long, r long, score long")


def frequent_phrases(docs: DataFrame, mining: Mining = Mining()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, pairs, longer, sizes): all phrases found at least ``least`` times by length, and all words of each language."""
    context = docs.sparkSession.sparkContext
    words = materialise(counted(docs, 1), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.filter(F.col("n") >= mining.least)
    may_words = context.broadcast(bloom(words, 1))
    pairs = materialise(counted(docs, 2, may_words).filter(F.col("n") >= mining.least), "pairs")
    may_pairs = context.broadcast(bloom(pairs, 2))
    longer = materialise(beginnings(counted(docs, 3, pairs=may_pairs), mining.least), "longer-phrases")
    return words, pairs, longer, sizes


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    ``docs`` needs text and lang; other columns don't matter. A null lang is ``und``, a null text is empty,
    repeated rows count each time, texts are read whole. Phrases inside a longer one that is found as
    often go; it is enough to look at phrases one word longer, as those between are as frequent. Ranks are
    by score, then count, both descending, then by the bytes of the phrase. An empty table gives no rows.
    """
    words, pairs, longer, sizes = frequent_phrases(docs, mining)
    single = words.select("lang", F.col("phrase").alias("word"), F.col("n").alias("single"))
    two = pairs.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    two = two.withColumns({"first": F.col("words")[0], "second": F.col("words")[1]})
    for side in ("first", "second"):
        other = single.select(F.col("lang"), F.col("word").alias(side), F.col("single").alias(f"{side}_n"))
        two = two.join(other.hint("merge"), ["lang", side])
    none = F.lit(None).cast("long")
    stream = two.select("lang", "words", "a", F.col("first_n").alias("outer"), F.array("second_n").alias("carried")).unionByName(
        longer.select("lang", "words", "a", none.alias("outer"), F.array(none).alias("carried"))
    )
    prefix = in_lockstep(stream)
    # in suffix order the stream brings along what prefix order has found: lefts, and the largest extension last
    turned = prefix.select(
        "lang", F.reverse("words").alias("words"), "a", F.col("carried")[0].alias("outer"), F.concat("inner", F.array("extended")).alias("carried"),
    )
    suffix = in_lockstep(turned)
    whole = suffix.filter(F.greatest("extended", F.element_at("carried", -1)) < F.col("a")).select(
        "lang", F.array_join(F.reverse("words"), " ").alias("phrase"), "a",
        F.slice("carried", F.lit(1), F.size("carried") - 1).alias("lefts"), F.col("inner").alias("rights"),
    )
    ranked = scored(whole.join(sizes, "lang"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= mining.top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
