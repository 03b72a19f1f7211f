"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Every record is hashed into one of a few thousand slots for good. Only the map from slots to
shards changes: each version is a small table, and a new version moves whole slots. Placement is
therefore decided on at most ``n_slots`` totals, however many records there are.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelyard.sizing import materialise

SLOTS = 4096


def measured(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and virtual_slot of every row.

    A null text counts as empty. The slot follows from the id and the text's checksum, so rows that
    share an id but not a text are spread. Rows equal in both, null ids included, share a slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int")
    return rows.withColumn("virtual_slot", slot)


def slot_totals(rows: DataFrame, n_slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Rows and bytes of each slot; the aggregate has at most ``n_slots`` rows."""
    counts, sizes = [0] * n_slots, [0] * n_slots
    totals = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    for row in totals.collect():
        counts[row["virtual_slot"]], sizes[row["virtual_slot"]] = row["n"], row["bytes"]
    return counts, sizes


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: slots dealt in turn, before any size is known."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalanced(shards: list[int], sizes: list[int], n_shards: int) -> list[int]:
    """The next version: a shard keeps its slots, largest first, up to an equal share of the bytes.

    What does not fit is dealt to the lightest shard, largest slot first. Slots that stay are not
    moved, and shards that did not exist before (``n_shards`` grew) only receive.
    """
    share = sum(sizes) / n_shards
    load, moving, edited = [0] * n_shards, [], list(shards)
    for slot in sorted(range(len(shards)), key=lambda s: (-sizes[s], s)):
        shard = shards[slot]
        if shard < n_shards and load[shard] + sizes[slot] <= share:
            load[shard] += sizes[slot]
        else:
            moving.append(slot)
    heap = [(bytes_, shard) for shard, bytes_ in enumerate(load)]
    heapq.heapify(heap)
    for slot in moving:
        bytes_, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (bytes_ + sizes[slot], shard))
    return edited


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """The stored map: version, virtual_slot, shard."""
    held = F.from_json(F.lit(json.dumps(versions)), "array<array<int>>")
    return (
        spark.range(1).select(F.posexplode(held).alias("version", "shards"))
        .select("version", F.posexplode("shards").alias("virtual_slot", "shard"))
    )


def _places(counts: list[int], shards: list[int], n_shards: int) -> list[int]:
    """Rows of the same shard in lower slots, for each slot."""
    seen, before = [0] * n_shards, []
    for n, shard in zip(counts, shards):
        before.append(seen[shard])
        seen[shard] += n
    return before


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Place every row in one of ``n_shards`` shards of near equal bytes; returns rows and the map.

    Rows: doc_id, size, text_crc32, virtual_slot, map_version, shard and slot, which is the row's
    place in its shard, gapless from 0. Only ids, sizes and checksums are shuffled, by virtual slot,
    and the place is the place within the slot plus a count known from the totals, so no task
    sorts a whole shard. The map has at most ``n_slots`` rows and is broadcast.

    An empty table gives no rows and a map. Null texts are empty texts. Repeated rows are placed one
    by one, in no particular order among themselves. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialise(measured(docs, n_slots), "slot-rows")
    counts, sizes = slot_totals(rows, n_slots)
    versions = [first_map(n_slots, n_shards)]
    versions.append(rebalanced(versions[0], sizes, n_shards))
    stored = materialise(map_table(spark, versions), "slot-map")
    before = F.from_json(F.lit(json.dumps(_places(counts, versions[-1], n_shards))), "array<long>")
    latest = (
        stored.filter(F.col("version") == len(versions) - 1)
        .join(spark.range(1).select(F.posexplode(before).alias("virtual_slot", "before")), "virtual_slot")
        .select("virtual_slot", F.col("version").alias("map_version"), "shard", "before")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = (
        rows.withColumn("within", F.row_number().over(within) - 1)
        .join(F.broadcast(latest), "virtual_slot")
        .withColumn("slot", F.col("before") + F.col("within"))
        .drop("before", "within")
    )
    return placed, stored
