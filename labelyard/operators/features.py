"""Text and vector features of the supervised arms."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import tokens
from ..sizing import fits

# Terms found in more documents than this share are joined by broadcast. With T
# distinct terms per document on average there are at most T / share of them.
HOT_SHARE = 0.01
# Up to this many items, and 64 MB, their norms are broadcast.
NORM_ROWS = 4_000_000
# Words counted at a time, unless one item has more.
WORDS = 1 << 18
# Occurrences to a packed row, unless one term has more.
CHUNK = 1 << 16
# Occurrences that a task deals out at a time, and characters of text to a share and to a part of the terms. A task
# has the packed blocks of a share and unpacks one part of it.
DEALT = 1 << 21
SHARE_CHARS = 1 << 26
PART_CHARS = 1 << 23
# Characters of text that a term of a vocabulary is taken for there.
TERM_CHARS = 12


def term_counts(items: DataFrame, num_features: int | None = None) -> DataFrame:
    """Occurrences of each word and word pair per item: ``item_id, term, tf``.

    With ``num_features`` a term stands for all that hash into the same of so many columns.
    The texts are dealt out by item, so that their terms, which take far more room, are counted where they are.
    """
    layout = T.StructType([items.schema["item_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    counts = _words(items).mapInArrow(_counted, layout)
    if num_features:
        term = F.pmod(F.xxhash64("term"), F.lit(num_features)).cast("string")
        counts = counts.groupBy("item_id", term.alias("term")).agg(F.sum("tf").alias("tf"))
    return counts


def _words(items: DataFrame) -> DataFrame:
    """``item_id, words``: the words of each text of an item, each item in one task."""
    shares = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = items.select("item_id", "text").repartition(shares, "item_id").groupBy("item_id").agg(F.collect_list("text").alias("texts"))
    return texts.select("item_id", F.transform("texts", tokens).alias("words"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word pairs of each item, from the words of each of its texts; some items at a time."""
    for batch in batches:
        lists = batch.column(1)
        ends = np.cumsum(lists.flatten().value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        texts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.concatenate([[0], ends])[texts]  # words up to each item's end
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + WORDS, "right"))
            end = max(begin + 1, end)
            ids, lists = batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin)
            begin, per_text = end, lists.flatten()
            sizes = per_text.value_lengths().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(sizes)), sizes)
            item = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))[text]
            words = per_text.flatten().dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            first = np.flatnonzero(text[1:] == text[:-1])
            pairs, pair = np.unique(code[first] * len(names) + code[first + 1], return_inverse=True)
            left, right = (names.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(names))))
            joined = pc.binary_join_element_wise(left, right, " ")
            for owner, number, terms in ((item, code, names), (item[first], pair, joined)):
                found, tf = np.unique(owner * max(1, len(terms)) + number, return_counts=True)
                if len(found):
                    at, term = np.divmod(found, len(terms))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), terms.take(pa.array(term)), pa.array(tf.astype(np.int64))], ["item_id", "term", "tf"])


def occurrences(counts: DataFrame) -> DataFrame:
    """``term, df, held``: the items of each term, as one list with their counts.

    The occurrences of a term are shuffled once, and the length of its list is its ``df``.
    """
    lists = counts.groupBy("term").agg(F.collect_list(F.struct("item_id", "tf")).alias("held"))
    return lists.select("term", F.size("held").cast("long").alias("df"), "held")


def _idf(n_items: int) -> Column:
    return F.log((F.lit(1.0) + F.lit(n_items)) / (1 + F.col("df"))) + 1


Parting = tuple[int, int]


def characters(items: DataFrame) -> int:
    return items.agg(F.sum(F.length("text"))).first()[0] or 0


def parting(spark: SparkSession, chars: int | None) -> Parting:
    """Shares of the terms, and parts of each share, for texts of so many characters."""
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(chars or 0) // SHARE_CHARS))
    return shares, max(1, -(-(chars or 0) // (shares * PART_CHARS)))


def _written(*columns: pa.Array) -> bytes:
    """Arrays of any lengths as one compressed block."""
    row = pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], [str(i) for i in range(len(columns))]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _read(blocks: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    """The arrays of some blocks, each behind that of the block before, and the rows of the first one in every block."""
    rows = [pa.ipc.open_stream(block.as_buffer()).read_next_batch() for block in blocks]
    columns = [pa.concat_arrays([row.column(c).values for row in rows]) for c in range(rows[0].num_columns)]
    return [*columns, pa.array([len(row.column(0).values) for row in rows])]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
        if size and (batch is None or size >= rows):
            yield pa.Table.from_batches(held)
            held, size = [], 0


def _dealt(batches: Iterator[pa.RecordBatch], parting: Parting) -> Iterator[pa.RecordBatch]:
    """``share, part, block`` from ``item_id, term, tf``: some occurrences at a time, those of a term in one block, by a hash of the term.

    A block has its terms, how many items hold each of them here, and these items with their counts.
    """
    shares, each = parting
    for table in _gathered(batches, DEALT):
        coded = table["term"].combine_chunks().dictionary_encode()
        where = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(shares * each)
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = np.bincount(place, minlength=len(order))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        by_term = pa.array(np.argsort(place, kind="stable"))
        terms, sizes = coded.dictionary.take(pa.array(order)), pa.array(sizes.astype(np.int32))
        items, tfs = (table[c].combine_chunks().take(by_term) for c in ("item_id", "tf"))
        found, begins = np.unique(where[order], return_index=True)
        blocks = []
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
            first, rows = ends[begin], ends[end] - ends[begin]
            blocks.append(_written(
                terms.slice(begin, end - begin), sizes.slice(begin, end - begin), items.slice(first, rows), tfs.slice(first, rows)
            ))
        found = found.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array((found % shares).astype(np.int32)), pa.array((found // shares).astype(np.int32)), pa.array(blocks, pa.binary())],
            ["share", "part", "block"],
        )


BLOCKS = "share int, part int, block binary"


def term_blocks(items: DataFrame, parting: Parting) -> DataFrame:
    """The counts of ``term_counts`` in blocks, put together where the terms are counted."""
    return _words(items).mapInArrow(lambda batches: _dealt(_counted(batches), parting), BLOCKS)


def _merged(share: pa.Table, in_order: bool = False) -> Iterator[tuple[int, pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """Part by part of a share: ``part, terms, df, items, tfs``, the items of a term behind those of the terms before.

    Terms ``in_order`` are alphabetical, which takes a sort and less room when they are written.
    """
    parts = share["part"].to_numpy()
    for part in np.unique(parts).tolist():
        terms, sizes, items, tfs, _ = _read(share["block"].take(pa.array(np.flatnonzero(parts == part))))
        coded = terms.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if in_order:
            places = pc.sort_indices(terms)
            rank = np.empty(len(terms), np.int32)
            rank[places.to_numpy()] = np.arange(len(terms))
            terms, code = terms.take(places), rank[code]
        code = np.repeat(code, sizes.to_numpy())
        order = np.argsort(code, kind="stable")
        yield part, terms, np.bincount(code, minlength=len(terms)), items.take(pa.array(order)), tfs.to_numpy()[order]


def packed_occurrences(counts: DataFrame) -> DataFrame:
    """The occurrences ``item_id, term, tf`` by term, many terms to a row; an item is a whole number here.

    ``part, chunk`` name a row, ``n`` is its number of terms, ``starts, items, tfs`` are packed: where each term begins,
    and its items with their counts. A term is never cut, so the distance to the next start is its ``df``.
    """
    shares = parting(counts.sparkSession, None)
    return packed_blocks(counts.select("item_id", "term", "tf").mapInArrow(lambda batches: _dealt(batches, shares), BLOCKS))


def packed_blocks(blocks: DataFrame) -> DataFrame:
    """The packed rows of ``packed_occurrences`` from blocks; each block is shuffled once, as it is."""
    def pack(share: pa.Table) -> pa.Table:
        rows, chunk = [], 0
        for _, terms, df, items, tfs in _merged(share):
            ends = np.concatenate([[0], np.cumsum(df)])
            items, tfs, first = items.to_numpy().astype(np.int32), tfs.astype(float), 0
            while first < len(df):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
                begin, end = ends[first], ends[last]
                rows.append(pa.RecordBatch.from_arrays([
                    share["share"].chunk(0).slice(0, 1), pa.array([chunk], pa.int32()), pa.array([last - first], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), terms.slice(first, last - first)),
                    *(pa.array([x.tobytes()], pa.binary()) for x in ((ends[first:last] - begin).astype(np.int32), items[begin:end], tfs[begin:end])),
                ], ["part", "chunk", "n", "terms", "starts", "items", "tfs"]))
                chunk, first = chunk + 1, last
        return pa.Table.from_batches(rows)

    return blocks.groupBy("share").applyInArrow(pack, "part int, chunk int, n long, terms array<string>, starts binary, items binary, tfs binary")


def packed_weights(starts: np.ndarray, tfs: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed occurrences: ``df`` and ``idf`` of each term, and ``(1 + ln tf) * idf`` of each occurrence."""
    df = np.diff(starts, append=len(tfs))
    idf = np.log((1.0 + n_items) / (1 + df)) + 1
    return df, idf, (1 + np.log(tfs)) * np.repeat(idf, df)


def known_terms(counts: DataFrame, terms: DataFrame, n_items: int) -> tuple[DataFrame, Column]:
    """Occurrences of known terms with the term's columns, and the expression of their weight ``(1 + ln tf) * idf``.

    Terms that occur in a large share of the items would each land in a single
    join partition, so those few are joined by broadcast and only the rest is
    shuffled by term. Terms the dictionary lacks are left out.
    """
    hot_from = max(1.0, HOT_SHARE * n_items)
    hot = terms.filter(F.col("df") > hot_from)
    if fits(hot):
        hot = F.broadcast(hot)
        rest = terms.filter(F.col("df") <= hot_from)
        joined = counts.join(hot, "term").unionByName(
            counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(rest, "term")
        )
    else:
        joined = counts.join(terms, "term")
    return joined, (1 + F.log(F.col("tf"))) * F.col("idf")


def weighted_terms(counts: DataFrame, terms: DataFrame, n_items: int) -> DataFrame:
    """L2-normalised weights of the known terms of each item, with the term's columns."""
    joined, raw = known_terms(counts, terms, n_items)
    norm = F.sqrt(F.sum(raw * raw).over(W.partitionBy("item_id")))
    return joined.withColumn("weight", raw / norm)


def weighted_occurrences(held: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """``item_id, term, tf, df, idf, weight``: the weights of ``weighted_terms`` for the items of the lists themselves.

    What comes back to an item is its norm, by broadcast unless there are too many items.
    """
    rows = held.select("term", "df", F.explode("held").alias("e")).select("e.item_id", "term", "e.tf", "df", _idf(n_items).alias("idf"))
    raw = (1 + F.log(F.col("tf"))) * F.col("idf")
    if fits(items.select("item_id"), NORM_ROWS):
        norms = rows.groupBy(F.col("item_id").alias("_item")).agg(F.sqrt(F.sum(raw * raw)).alias("_norm"))
        rows = rows.join(F.broadcast(norms), F.col("item_id").eqNullSafe(F.col("_item")))
    else:
        rows = rows.withColumn("_norm", F.sqrt(F.sum(raw * raw).over(W.partitionBy("item_id"))))
    return rows.select("item_id", "term", "tf", "df", "idf", (raw / F.col("_norm")).alias("weight"))


def plain_ids(items: DataFrame) -> bool:
    """True for ids that blocks can be summed by: whole numbers and strings compared by their bytes."""
    kind = items.schema["item_id"].dataType
    return isinstance(kind, T.IntegralType) or kind == T.StringType()


def _summed(ids: pa.Array | None, sums: np.ndarray | None, items: pa.Array, numbers: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Sums by item (a row for each of the numbers), with those of further occurrences added."""
    coded = items.dictionary_encode(null_encoding="encode")
    code, found = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    here = np.stack([np.bincount(code, x, len(found)) for x in numbers])
    if ids is None:
        return found, here
    both = pa.concat_arrays([ids, found]).dictionary_encode(null_encoding="encode")
    code = both.indices.to_numpy(zero_copy_only=False)
    return both.dictionary, np.stack([np.bincount(code, np.concatenate(x), len(both.dictionary)) for x in zip(sums, here)])


def known_sums(items: DataFrame, terms: DataFrame, columns: int) -> DataFrame:
    """``item_id, squares, s0, s1, ...`` of the known terms of each item: the squares of their weights before they are normalised,
    and these weights times the numbers ``w`` of the terms, summed.

    Occurrences and terms meet in blocks by a hash of the term; what is shuffled by item is a row for each share.
    """
    parts = shares, each = parting(items.sparkSession, max(characters(items), TERM_CHARS * terms.count()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, max(1, DEALT // 2 // columns)):
            names, idf, w = (x.combine_chunks() for x in table.columns)
            w = w.flatten().to_numpy().reshape(-1, columns)
            where = (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(shares * each)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            found, begins = np.unique(where[order], return_index=True)
            names, idf, w = names.take(pa.array(order)), idf.take(pa.array(order)), w[order]
            blocks = [
                _written(names.slice(a, b - a), idf.slice(a, b - a), pa.array(w[a:b].ravel()))
                for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (found % shares, found // shares)] + [pa.array(blocks, pa.binary())], ["share", "part", "block"])

    names = ["item_id", "squares", *[f"s{c}" for c in range(columns)]]
    layout = T.StructType([items.schema["item_id"], *[T.StructField(name, T.DoubleType()) for name in names[1:]]])
    empty = to_arrow_schema(layout).empty_table()

    def met(share: pa.Table, known: pa.Table) -> pa.Table:
        ids, sums, parts, theirs = None, None, share["part"].to_numpy(), known["part"].to_numpy()
        for part in np.intersect1d(parts, theirs).tolist():
            terms, sizes, items, tfs, _ = _read(share["block"].take(pa.array(np.flatnonzero(parts == part))))
            told, idf, w, _ = _read(known["block"].take(pa.array(np.flatnonzero(theirs == part))))
            at = pc.index_in(terms, value_set=told).fill_null(-1).to_numpy()
            at = np.repeat(at, sizes.to_numpy())
            held = np.flatnonzero(at >= 0)
            at, w = at[held], w.to_numpy().reshape(-1, columns)
            raw = (1 + np.log(tfs.to_numpy()[held])) * idf.to_numpy()[at]
            ids, sums = _summed(ids, sums, items.take(pa.array(held)), [raw * raw, *(raw * w[at, c] for c in range(columns))])
        return empty if ids is None else pa.table([ids, *map(pa.array, sums)], names)

    dealt = terms.select("term", "idf", "w").mapInArrow(deal, BLOCKS)
    return term_blocks(items, parts).groupBy("share").cogroup(dealt.groupBy("share")).applyInArrow(met, layout)


def _weights(df: np.ndarray, tfs: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """``idf`` of each term, and ``(1 + ln tf) * idf`` of each occurrence."""
    _, idf, raw = packed_weights(np.cumsum(df) - df, tfs, n_items)
    return idf, raw


def _buckets(ids: pa.Array, count: int) -> np.ndarray:
    """A bucket for each id, the same wherever it is found."""
    if pa.types.is_integer(ids.type):
        keys = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    else:
        keys = ids.fill_null("").to_numpy(zero_copy_only=False)
    return (pd.util.hash_array(keys, categorize=False) % np.uint64(count)).astype(np.int64)


def weighted_blocks(blocks: DataFrame, id_field: T.StructField, n_items: int, parting: Parting) -> DataFrame:
    """``item_id, term, tf, df, idf, weight`` from blocks of the items themselves, whose ids are whole numbers or strings.

    Every share sums the squares of its items; they meet by a bucket of the items, and each share gets back the norms of
    its own items in the order of its sums. Nothing is broadcast, and no occurrence is shuffled twice.
    """
    buckets = parting[0]

    def squares(share: pa.Table) -> pa.Table:
        ids, sums = None, None
        for _, _, df, items, tfs in _merged(share):
            _, raw = _weights(df, tfs, n_items)
            ids, sums = _summed(ids, sums, items, [raw * raw])
        where = _buckets(ids, buckets)
        order = np.argsort(where, kind="stable")
        found, begins = np.unique(where[order], return_index=True)
        ids, sums = ids.take(pa.array(order)), pa.array(sums[0][order])
        written = [_written(ids.slice(a, b - a), sums.slice(a, b - a)) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)])]
        own = share["share"].chunk(0)[0].as_py()
        return pa.table([pa.array(found.astype(np.int32)), pa.array([own] * len(found), pa.int32()), pa.array(written, pa.binary())], ["bucket", "share", "sums"])

    def norms(bucket: pa.Table) -> pa.Table:
        ids, sums, sizes = _read(bucket["sums"])
        coded = ids.dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        norm = np.sqrt(np.bincount(code, sums.to_numpy(), len(coded.dictionary)))[code]
        ends = np.cumsum(sizes.to_numpy())
        written = [_written(ids.slice(a, b - a), pa.array(norm[a:b])) for a, b in zip((ends - sizes.to_numpy()).tolist(), ends.tolist())]
        return pa.table([bucket["share"], pa.array(written, pa.binary())], ["share", "norms"])

    def weighted(share: pa.Table, back: pa.Table) -> pa.Table:
        ids, norm, _ = _read(back["norms"])
        norm, rows = norm.to_numpy(), []
        for _, terms, df, items, tfs in _merged(share, in_order=True):
            idf, raw = _weights(df, tfs, n_items)
            coded = items.dictionary_encode(null_encoding="encode")
            at = pc.index_in(coded.dictionary, value_set=ids).to_numpy(zero_copy_only=False)
            term = np.repeat(np.arange(len(df)), df)
            weight = raw / norm[at][coded.indices.to_numpy(zero_copy_only=False)]
            for begin in range(0, len(term), CHUNK):
                here = slice(begin, begin + CHUNK)
                rows.append(pa.RecordBatch.from_arrays([
                    items.slice(begin, CHUNK), terms.take(pa.array(term[here])), pa.array(tfs[here]), pa.array(df[term[here]]),
                    pa.array(idf[term[here]]), pa.array(weight[here]),
                ], ["item_id", "term", "tf", "df", "idf", "weight"]))
        return pa.Table.from_batches(rows)

    layout = T.StructType([id_field, *(T.StructField(name, kind()) for name, kind in (
        ("term", T.StringType), ("tf", T.LongType), ("df", T.LongType), ("idf", T.DoubleType), ("weight", T.DoubleType)))])
    sums = blocks.groupBy("share").applyInArrow(squares, "bucket int, share int, sums binary")
    back = sums.groupBy("bucket").applyInArrow(norms, "share int, norms binary")
    return blocks.groupBy("share").cogroup(back.groupBy("share")).applyInArrow(weighted, layout)


def tfidf(items: DataFrame) -> DataFrame:
    """Weights of all words and word pairs of ``items``, measured against the items themselves."""
    size, field = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first(), items.schema["item_id"]
    if plain_ids(items):
        shares = parting(items.sparkSession, size["chars"])
        return weighted_blocks(term_blocks(items, shares), field, size["n"], shares)
    return weighted_occurrences(occurrences(term_counts(items)), items, size["n"])


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (k * n_label)`` per label."""
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_label"))
    every = W.partitionBy()  # one row per label
    n, k = F.sum("n_label").over(every), F.count(F.lit(1)).over(every)
    return counts.select("label", "n_label", (n / (k * F.col("n_label"))).alias("weight"))


def masked_mean_pool(
    vectors: DataFrame, by: str = "item_id", vector: str = "vector", mask: str = "mask"
) -> DataFrame:
    """Mean of the unmasked token vectors of each item, as an array.

    The tokens of an item are summed as vectors on the map side, so one row per item and task
    is shuffled. An item whose tokens are all masked pools to zeros.
    """
    used = F.col(mask).cast("double")
    rows = vectors.select(by, used.alias("m"), array_to_vector(F.transform(vector, lambda x: x.cast("double") * used)).alias("v"))
    pooled = rows.groupBy(by).agg(Summarizer.sum(F.col("v")).alias("total"), F.sum("m").alias("weight"))
    least = F.greatest(F.col("weight"), F.lit(1e-9))
    return pooled.select(by, F.transform(vector_to_array("total"), lambda x: x / least).alias("pooled"))
