"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes decides where a chunk ends, so chunks depend on what they
hold and not on where they stand: after an insertion the cuts fall into step again. Chunks are
compared by digest over the whole corpus. A repeated stretch is removed where it is at least
``LEAST_WORDS`` words long and not its first occurrence, so that phrases everyone uses stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelyard.llm.columns import set_aside
from labelyard.llm.shingles import byte_hashes, mixed, raw
from labelyard.llm.workers import batches_of_texts
from labelyard.sizing import materialise

#: A chunk ends where these bits of the hash are zero: one byte in 32.
CUT_MASK = 0xF8000000
LEAST_WORDS = 25
#: Bits for each repeated chunk in the filter that keeps unique ones from a shuffle, at most so many.
FILTER_BITS, LARGEST_BITS, SEGMENT_BITS = 16, 1 << 28, 1 << 18


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the texts in ``data``; a text's last byte ends one.

    The rolling hash starts anew with each text: h(i) = 2 h(i-1) + gear(byte i), modulo 2^32, summed
    here by doubling the number of bytes it spans. There is no shortest or longest chunk.
    """
    gear = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    age = np.arange(len(data)) - begin
    h = gear[data]
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        shifted[age < step] = 0
        h = h + shifted
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = (h & np.uint32(CUT_MASK)) == 0
    ends[offsets[1:][np.diff(offsets) > 0]] = True
    return np.flatnonzero(ends)


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its chunks' ends (bytes from its start) and digests (64 bits)."""
    data, offsets = raw(texts)
    ends = chunk_ends(data, offsets)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    digests = byte_hashes(data, starts, ends) if len(ends) else np.zeros(0, np.uint64)
    at = np.searchsorted(ends, offsets, side="right")
    for start, a, b in zip(offsets[:-1].tolist(), at[:-1].tolist(), at[1:].tolist()):
        yield ends[a:b] - start, digests[a:b].view(np.int64)


def _bits(digests: np.ndarray, bits: int) -> np.ndarray:
    d = digests.view(np.uint64)
    return np.stack([d & np.uint64(bits - 1), (d >> np.uint64(32)) & np.uint64(bits - 1)], axis=1).astype(np.int64)


def _filter_of(digests: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the digests, built in tasks and merged by segment."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unique(np.concatenate([_bits(b.column(0).to_numpy(), bits).ravel() for b in batches] or [np.zeros(0, np.int64)]))
        for number in np.unique(held // SEGMENT_BITS).tolist():
            here = np.zeros(SEGMENT_BITS, bool)
            a, b = np.searchsorted(held, [number * SEGMENT_BITS, (number + 1) * SEGMENT_BITS])
            here[held[a:b] - number * SEGMENT_BITS] = True
            packed = np.packbits(here).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.frombuffer(packed, np.uint8)
                sums[number] = sums[number] | here if number in sums else here
        for number, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["segment", "bits"])

    schema = "segment int, bits binary"
    merged = digests.mapInArrow(build, schema).repartition(max(1, min(64, bits // SEGMENT_BITS)), "segment").mapInArrow(merge, schema)
    whole = bytearray(bits // 8)
    for row in merged.toLocalIterator():
        whole[row["segment"] * (SEGMENT_BITS // 8):(row["segment"] + 1) * (SEGMENT_BITS // 8)] = row["bits"]
    return bytes(whole)


def _chunk_rows(docs: DataFrame, shared=None, bits: int = 0) -> DataFrame:
    """digest, doc_id of every chunk; with a filter only of those that may be repeated."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for some in batches_of_texts(batch, 1):
                parts = [d for _, d in chunks(some.column(1))]
                of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                digests = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                if held is not None:
                    at = _bits(digests, bits)
                    hit = ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                    digests, of = digests[hit], of[hit]
                yield pa.RecordBatch.from_arrays([pa.array(digests), some.column(0).take(pa.array(of))], ["digest", "doc_id"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(emit, "digest long, doc_id long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id and digest of chunks that another document with a smaller id holds too.

    Every chunk is counted once, as a digest and an id; the rest of the work sees only the repeated.
    A null id is greater than any other; among null ids the chunk counts as repeated for all.
    """
    counted = _chunk_rows(docs).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = materialise(counted.select("digest", "first"), "repeated-chunks")
    n = counted.count()
    bits = min(LARGEST_BITS, max(SEGMENT_BITS, 1 << (max(1, n * FILTER_BITS) - 1).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(counted.select("digest"), bits))
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.col("doc_id").isNull())
    return _chunk_rows(docs, shared, bits).distinct().join(counted, "digest").filter(later).select("doc_id", "digest")


def repeated_spans(text: bytes, ends: np.ndarray, digests: np.ndarray, elsewhere: set[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Byte spans to remove: runs of chunks known from elsewhere or from earlier in the text.

    A run ends with its last whole chunk. Spans are moved to the nearest code point inside.
    """
    seen: set[int] = set()
    spans, start, begin = [], None, 0
    for end, digest in zip([*ends.tolist(), None], [*digests.tolist(), None]):
        again = digest is not None and (digest in elsewhere or digest in seen)
        seen.add(digest)
        if again and start is None:
            start = begin
        if not again and start is not None:
            a, b = start, begin
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
            if len(text[a:b].split()) >= least_words:
                spans.append((a, b))
            start = None
        begin = end
    return spans


def drop_repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without passages that an earlier document, or the same one before, holds already.

    All columns stay, with the remaining text in ``text``; n_chunks, spans ("start:end" in code points
    of the old text, comma-joined) and n_removed (code points) are added or overwritten. The
    first document is the one with the smallest id. A null or empty text has no chunks and stays as it is.
    Of rows with one id, each keeps its first occurrence. An empty table stays empty.
    """
    docs, back = set_aside(docs.drop("n_chunks", "spans", "n_removed"))
    columns = docs.columns
    known = repeated_chunks(docs).groupBy(F.col("doc_id").alias("_chunk_id")).agg(F.collect_list("digest").alias("_known"))
    whole = docs.select(*columns)
    joined = whole.join(known.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_chunk_id")), "left").drop("_chunk_id")
    names = joined.columns
    text_at, known_at = names.index("text"), names.index("_known")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in batches_of_texts(batch, text_at):
                texts, counts, marks, removed = [], [], [], []
                for text, held, (ends, digests) in zip(some.column(text_at).to_pylist(), some.column(known_at).to_pylist(), chunks(some.column(text_at))):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    counts.append(len(ends))
                    repeats = held or len(np.unique(digests)) < len(digests)
                    spans = repeated_spans(data, ends, digests, set(held or ()), least_words) if repeats else []
                    rest, at, place, listed, gone = [], 0, 0, [], 0
                    for a, b in spans:
                        kept, lost = data[at:a].decode("utf-8", "replace"), len(data[a:b].decode("utf-8", "replace"))
                        rest.append(kept)
                        place += len(kept)
                        listed.append(f"{place}:{place + lost}")
                        place, gone, at = place + lost, gone + lost, b
                    texts.append(text if not spans else "".join(rest) + data[at:].decode("utf-8", "replace"))
                    marks.append(",".join(listed))
                    removed.append(gone)
                arrays = [some.column(i) for i in range(len(names)) if i != known_at]
                arrays[columns.index("text")] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(removed, pa.int64())],
                    [*columns, "n_chunks", "spans", "n_removed"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields)
    return joined.mapInArrow(cut, schema + ", n_chunks long, spans string, n_removed long").withColumnsRenamed(back)
