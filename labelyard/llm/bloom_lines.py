"""Line deduplication with two Bloom filters.

The first filter holds the lines that a first document has shown, the second those that a second
one has shown as well. Both are built in one pass in which only bit positions are shuffled. A
line that is not in the second filter occurs in one document and is never shuffled; the others
are counted exactly by a 128-bit digest of their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from labelyard.llm.columns import set_aside
from labelyard.sizing import materialise

#: White space that is stripped from both ends of a line.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits for each expected line, hash functions, and the largest filter; a fuller filter only lets
#: more lines be counted.
BITS_PER_LINE, HASHES, LARGEST_BITS = 8, 2, 1 << 28
SEGMENT_BITS = 1 << 18
KEY = "digest binary, doc_id long"


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """For each line its digest, or None if the key is shorter than ``least`` code points.

    The key is the line without blanks at its ends and with A-Z in lower case.
    """
    keys = [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]
    return [xxhash.xxh3_128_digest(k) if _long_enough(k, least) else None for k in keys]


def positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, a row per digest and a column per hash; ``digests`` are 16 bytes each."""
    words = np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 2)
    return np.stack([(words[:, 0] + np.uint64(k) * words[:, 1]) & np.uint64(bits - 1) for k in range(HASHES)], axis=1).astype(np.int64)


def filter_bits(lines: int, bits_per_line: int = BITS_PER_LINE, largest: int = LARGEST_BITS) -> int:
    """A power of two with room for that many lines, as far as ``largest`` goes."""
    return min(largest, max(SEGMENT_BITS, 1 << (max(1, lines * bits_per_line) - 1).bit_length()))


def segments(digests: list[bytes], bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Once-seen and twice-seen filters of one task, as packed stretches that have any bit.

    ``digests`` are those of all its documents, each at most once per document. Only one stretch is
    held unpacked at a time.
    """
    found, times = np.unique(np.array(digests, dtype="S16").view("V16"), return_counts=True)
    at = positions(found, bits)
    once, twice = np.unique(at), np.unique(at[times > 1])
    for number in np.unique(once // SEGMENT_BITS).tolist():
        packed = []
        for held in (once, twice):
            here = np.zeros(SEGMENT_BITS, dtype=bool)
            a, b = np.searchsorted(held, [number * SEGMENT_BITS, (number + 1) * SEGMENT_BITS])
            here[held[a:b] - number * SEGMENT_BITS] = True
            packed.append(np.packbits(here).tobytes())
        yield number, *packed


def _digests(text: str | None, least: int) -> set[bytes]:
    return {k for k in line_keys(text, least) if k}


def twice_seen(docs: DataFrame, bits: int, least: int) -> bytes:
    """The packed filter of lines seen by a second document; ``bits`` / 8 bytes.

    Tasks ship their filters in segments. Those of one segment meet in one task, which keeps two
    bits per position of its segments and reads the rest as a stream.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        for batch in batches:
            for text in batch.column(0):
                digests += _digests(text.as_py(), least)
        for row in segments(digests, bits) if digests else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["segment", "once", "twice"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, a, b in zip(*(batch.column(c).to_pylist() for c in range(3))):
                first, second = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if number in once:
                    twice[number] |= second | (once[number] & first)
                    once[number] |= first
                else:
                    once[number], twice[number] = first.copy(), second.copy()
        for number, held in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["segment", "twice"])

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary")
    merged = parts.repartition(max(1, min(bits // SEGMENT_BITS, 64)), "segment").mapInArrow(merge, "segment int, twice binary")
    whole = bytearray(bits // 8)
    for row in merged.toLocalIterator():
        start = row["segment"] * (SEGMENT_BITS // 8)
        whole[start:start + SEGMENT_BITS // 8] = row["twice"]
    return bytes(whole)


def repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """digest, keeper: keys that at least ``documents`` rows hold, and the largest doc_id among them.

    Only lines that the second filter knows are shuffled. Rows are documents: two rows with one id
    count as two. A null id is never the largest unless all are null.
    """
    spark = docs.sparkSession
    n_chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = filter_bits(n_chars // (2 * least))
    shared = spark.sparkContext.broadcast(twice_seen(docs, bits, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                digests = list(_digests(text.as_py(), least))
                ids += [doc_id] * len(digests)
                found += digests
            if found:
                at = positions(np.array(found, dtype="S16").view("V16"), bits)
                hit = ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                rows = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found[i] for i in rows], pa.binary()), pa.array([ids[i] for i in rows], pa.int64())], ["digest", "doc_id"]
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = materialise(source.mapInArrow(suspects, KEY), "suspected-lines")
    confirmed = (
        held.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= documents).select("digest", "keeper")
    )
    return held.join(confirmed, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "digest")


def drop_repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """Take lines that at least ``documents`` documents hold out of all but the largest doc_id.

    All columns stay, with the remaining text in ``text``, and n_lines and n_dropped are added
    (overwritten if they exist). Every line with the key goes, repeated ones too; in the keeper
    every one stays. A null or empty text is one empty line and becomes empty. Keys with fewer than
    ``least`` code points always stay. Rows that share an id share their fate. An empty table
    stays empty. Texts are shuffled once, by id; a document's list of lines to drop is not longer
    than the document.
    """
    docs, back = set_aside(docs.drop("n_lines", "n_dropped"))
    columns = docs.columns
    drops = repeated_lines(docs, least, documents).groupBy(F.col("doc_id").alias("_drop_id")).agg(F.collect_set("digest").alias("_drops"))
    whole = docs.select(*columns)
    joined = whole.join(drops.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_drop_id")), "left").drop("_drop_id")
    names = joined.columns
    text_at, drops_at = names.index("text"), names.index("_drops")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, drop in zip(batch.column(text_at).to_pylist(), batch.column(drops_at).to_pylist()):
                text = text or ""
                if not drop:
                    texts.append(text)
                    lines.append(text.count("\n") + 1)
                    gone.append(0)
                    continue
                held = set(drop)
                keep = [k not in held for k in line_keys(text, least)]
                texts.append("\n".join(line for line, stays in zip(text.split("\n"), keep) if stays))
                lines.append(len(keep))
                gone.append(len(keep) - sum(keep))
            arrays = [batch.column(i) for i in range(len(names)) if i != drops_at]
            arrays[columns.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*columns, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields)
    return joined.mapInArrow(cut, schema + ", n_lines long, n_dropped long").withColumnsRenamed(back)
