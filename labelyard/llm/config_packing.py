"""Packing documents into fixed-length token sequences by a configuration linear program.

Only the histogram of lengths, at most ``capacity`` numbers, decides how sequences are composed.
The linear program over configurations (multisets of lengths that fit into one sequence) is solved
by multiplicative weights: lengths that are covered less than others gain weight, and a knapsack
dynamic program prices the best configurations. Its solution is rounded to whole sequences, and
the few pieces left are placed where they fit best.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from labelyard.llm.workers import per_worker, slices
from labelyard.sizing import materialise

CAPACITY = 2048
ITERATIONS = 40
#: Words whose ids a worker keeps; beyond, it starts anew.
CACHED_WORDS = 250_000
BUCKETS = 64
SLICE_BYTES = 32 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class GroupIds(dict):
    """Token ids of a group, as little-endian bytes, merged once and kept.

    A group is what the vocabulary's splitter makes of lowered text: letters, one digit, or marks.
    """

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self._merges = tokenizer.model
        self._id_bytes = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values()) + 1)]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self._spelled = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(33), 127, *range(0xC0, 0x100)]}

    def __missing__(self, group: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        spelled = group if group.isascii() and group.isprintable() else group.translate(self._spelled)
        self[group] = found = b"".join([self._id_bytes[t.id] for t in self._merges.tokenize(spelled)])
        return found


class WordIds(dict):
    """Token ids of a word of lowered plain Latin text, composed of those of its groups."""

    _GROUPS = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\t-\\r a-zß-öø-ÿ0-9]+")

    def __init__(self, tokenizer):
        super().__init__()
        self._groups = GroupIds(tokenizer)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = b"".join(map(self._groups.__getitem__, self._GROUPS.findall(word)))
        return found


class TextIds:
    """Token ids of many texts at once, as little-endian bytes.

    The vocabulary never looks across white space, so each different word of a batch is looked up
    once and the ids are gathered. A text with characters other than plain Latin, or with what
    may be a special token, is left to the tokenizer as a whole.
    """

    _OTHER = re.compile("[^\\x00-\x7fÀ-ÖØ-öø-ÿ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = WordIds(self._tokenizer)

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bool:
        return not ("<|" in text or not text.isascii() and self._OTHER.search(text))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self._plain(t) for t in texts]
        lowered = pa.array([t.lower() if ok else "" for t, ok in zip(texts, plain)], pa.large_string())
        lists = pc.ascii_split_whitespace(lowered)
        coded = lists.flatten().dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False)
        found = list(map(self._words.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        long = size[word]
        ends = np.cumsum(long)
        gathered = ids[np.repeat(first[word] - (ends - long), long) + np.arange(int(long.sum()))].tobytes()
        stops = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4
        for text, ok, start, stop in zip(texts, plain, stops[:-1].tolist(), stops[1:].tolist()):
            yield gathered[start:stop] if ok else self.whole(text)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; a document is its ids and then ``separator``.

    doc_id, piece, start (its document's ids before it), length, ids_crc32 and, if asked for, the
    ids. A null text counts as empty and is the separator alone. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = per_worker(("tokenizer", tokenizer), lambda: TextIds(tokenizer)), np.array([separator], dtype="<u4").tobytes()
        for batch in batches:
            for start, n in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, n)
                yield _pieces(part.column(0).to_pylist(), ids.of([t or "" for t in part.column(1).to_pylist()]), end, capacity, with_ids)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def _pieces(doc_ids: list, encoded: Iterator[bytes], end: bytes, capacity: int, with_ids: bool) -> pa.RecordBatch:
    rows: list[tuple] = []
    blobs: list[np.ndarray] = []
    for doc_id, data in zip(doc_ids, encoded):
        data += end
        for piece, at in enumerate(range(0, len(data), 4 * capacity)):
            part = data[at:at + 4 * capacity]
            rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if with_ids:
                blobs.append(np.frombuffer(part, "<u4").astype(np.int32))
    columns = [pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    )]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array(blobs, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


# --- the plan: at most ``capacity`` lengths, on the driver -------------------------------------

def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value in each capacity, and the item taken last.

    ``lengths`` ascend. An item may be taken any number of times; -1 means that nothing is taken
    and one unit stays empty.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            worth = best[c - lengths[:fits[c]]] + values[:fits[c]]
            item = int(worth.argmax())
            if worth[item] > best[c] + 1e-12:
                best[c], last[c] = worth[item], item
    return best, last


def _completed(item: int, lengths: np.ndarray, last: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best configuration that holds ``item``, as (item, times)."""
    taken, room = Counter([item]), capacity - int(lengths[item])
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            taken[int(last[room])] += 1
            room -= int(lengths[last[room]])
    return tuple(sorted(taken.items()))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, iterations: int = ITERATIONS) -> dict[tuple, float]:
    """Configurations and how often each is used, covering all lengths about equally.

    The weight of a length falls exponentially with the share of it that is covered already. Each
    round adds, for every length, the best configuration that holds it, with multiplicities small
    enough that no length gains much more than its part of the round.
    """
    used: dict[tuple, float] = {}
    covered, part, need = np.zeros(len(lengths)), 1.0 / iterations, counts.astype(float)
    for _ in range(iterations):
        share = covered / need
        values = lengths / capacity * np.exp(-2.0 * (share - share.min()))
        best, last = price(values, lengths, capacity)
        worth = values + best[capacity - lengths]
        picked = np.flatnonzero(worth >= worth.max() * (1 - 0.05))
        late = np.flatnonzero(share <= share.min() + part)
        columns = {_completed(int(i), lengths, last, capacity) for i in np.union1d(picked, late)}
        amounts, gain = {}, np.zeros(len(lengths))
        for column in columns:
            amounts[column] = min(part * need[i] / times for i, times in column)
            for i, times in column:
                gain[i] += amounts[column] * times
        excess = np.maximum(1.0, gain / (2 * part * need))
        for column, amount in amounts.items():
            amount /= max(excess[i] for i, _ in column)
            used[column] = used.get(column, 0.0) + amount
            for i, times in column:
                covered[i] += amount * times
    return used


def best_fit(bins: Counter, lengths: np.ndarray, left: np.ndarray, capacity: int) -> Counter:
    """Place what is left, longest first, into the fullest sequences that take it, many at a time.

    ``bins`` counts equal sequences: a sorted tuple of (item, times) and how many have it.
    """
    by_room: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    for config, n in bins.items():
        by_room[capacity - sum(int(lengths[i]) * t for i, t in config)][config] = n
    for item in np.argsort(-lengths, kind="stable"):
        length, n = int(lengths[item]), int(left[item])
        room = length
        while n and room <= capacity:
            while n and by_room[room]:
                config, have = next(iter(by_room[room].items()))
                some = min(n, have)
                if some == have:
                    del by_room[room][config]
                else:
                    by_room[room][config] = have - some
                grown = Counter(dict(config))
                grown[int(item)] += 1
                key, into = tuple(sorted(grown.items())), by_room[room - length]
                into[key] = into.get(key, 0) + some
                n -= some
            room += 1
        if n:
            each = capacity // length
            for times, some in ((each, n // each), (n % each, 1)):
                if times and some:
                    into = by_room[capacity - times * length]
                    key = ((int(item), times),)
                    into[key] = into.get(key, 0) + some
    return Counter({c: n for room in by_room for c, n in room.items()})


def compose(histogram: dict[int, int], capacity: int = CAPACITY, iterations: int = ITERATIONS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole sequences that hold every piece once: ((length, times), ...), how many of them.

    Rounding is in passes. Each takes whole multiples of the fractional configurations, fullest
    first, as far as pieces last; the program is then solved anew for the rest, until a pass
    gains little. What is left after that is placed by best fit.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    bins: Counter = Counter()
    for _ in range(3):
        some = np.flatnonzero(left)
        if len(some) < 2:
            break
        before, now = int(left.sum()), lengths[some]
        used = fractional(now, left[some], capacity, iterations)
        filled = {c: sum(int(now[i]) * t for i, t in c) for c in used}
        for column in sorted(used, key=lambda c: (-filled[c], -int(now[c[-1][0]]), c)):
            config = tuple((int(some[i]), t) for i, t in column)
            n = min(int(used[column]), *(int(left[i]) // t for i, t in config))
            if n and filled[column] >= 0.98 * capacity:
                bins[config] += n
                for i, t in config:
                    left[i] -= n * t
        if left.sum() > 0.7 * before:
            break
    bins = best_fit(bins, lengths, left, capacity)
    return [(tuple((int(lengths[i]), t) for i, t in c), n) for c, n in sorted(bins.items())]


def slots_of(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), so that a rank finds its place."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for config, n in plan:
        offset = 0
        for length, times in config:
            for _ in range(times):
                rows.setdefault(length, []).append((ranks[length], sequence, offset))
                ranks[length] += n
                offset += length
        sequence += n
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


# --- the packing of all pieces ------------------------------------------------------------------

def ranked(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``rank``: the number of a piece among those of its length, from 0 and without gaps.

    A length that many pieces share is split into buckets by a hash; a bucket's rows are numbered,
    and the rows in earlier buckets, counted beforehand, are added.
    """
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("_within", F.row_number().over(within) - 1)
        .join(before, ["length", "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_within"))
        .drop("_bucket", "_within", "_before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, iterations: int = ITERATIONS) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read several times: pass a stored table. An empty table stays empty; equal rows
    are packed one by one. The broadcast plan holds at most a few places for each length and
    configuration, whatever the number of pieces.
    """
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    plan = slots_of(compose({int(r["length"]): int(r["n"]) for r in counted}, capacity, iterations))
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    n = pieces.sparkSession.sparkContext.defaultParallelism
    buckets = min(4096, max(BUCKETS, 8 * n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                rows, at = shared.value[int(one)], np.flatnonzero(length == one)
                slot = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = slot[:, 1] + rank[at] - slot[:, 0], slot[:, 2]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked(pieces, buckets).select(*names, "rank").mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise all documents once, store the pieces' lengths and checksums, and pack them."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
