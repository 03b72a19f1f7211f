"""Near-duplicate documents: exact Jaccard links over word shingles by a token-group matrix.

Documents with the same shingle set form a class. Similar classes are partitioned into groups, and
the matrix holds, for each token, the groups whose union contains it. For a query class, the
tokens shared with a group's union bound the overlap with every member; only groups whose bound
reaches what a link needs are opened and compared exactly.

Tokens are ordered by how frequent they are, and only the rarest of a set, its prefix, enter the
matrix: two sets that link share a token in their prefixes. The order comes from a counting sketch of
fixed size over the whole corpus; any order gives the same links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelyard.llm.columns import set_aside
from labelyard.llm.shingles import WORDS_PER_SHINGLE, shingle_sets
from labelyard.llm.workers import batches_of_texts
from labelyard.sizing import materialise

#: Without other values, a link needs 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
SKETCH_BITS, SEGMENT_BITS = 22, 16
GROUP_SIZE = 32


# --- the order of tokens -------------------------------------------------------------------------

def frequency_classes(docs: DataFrame, words: int) -> bytes:
    """For each hash bucket the logarithm of how many shingles of the corpus fall into it."""
    buckets, part = 1 << SKETCH_BITS, 1 << SEGMENT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in batches_of_texts(batch, 0):
                held = [s >> np.uint64(64 - SKETCH_BITS) for s in shingle_sets(some.column(0), words)]
                if held:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=buckets)
        for number in range(buckets // part):
            here = counts[number * part:(number + 1) * part]
            if here.any():
                packed = zlib.compress(np.minimum(here, 65535).astype("<u2").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["segment", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.frombuffer(zlib.decompress(packed), "<u2").astype(np.int64)
                sums[number] = sums[number] + here if number in sums else here
        for number, total in sums.items():
            classes = np.log2(total + 1).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([classes], pa.binary())], ["segment", "classes"])

    parts = docs.select("text").mapInArrow(count, "segment int, counts binary")
    merged = parts.repartition(buckets // part, "segment").mapInArrow(merge, "segment int, classes binary")
    whole = bytearray(buckets)
    for row in merged.collect():  # at most 2^SKETCH_BITS bytes
        whole[row["segment"] * part:(row["segment"] + 1) * part] = row["classes"]
    return bytes(whole)


def prefix_length(n: int, threshold: int) -> int:
    return n + (-threshold * n // 100) + 1


def token_sets(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (of equal sets) and prefix (rarest tokens) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for some in batches_of_texts(batch, 2):
                sizes, ids, prefixes = [], [], []
                for tokens in shingle_sets(some.column(2), words):
                    sizes.append(len(tokens))
                    ids.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None)
                    order = np.argsort(classes[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    prefixes.append(tokens[order[:prefix_length(len(tokens), threshold)]].view(np.int64) if len(tokens) else [])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_shingles", "set_id", "prefix"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(build, "doc_id long, text_key long, n_shingles long, set_id long, prefix array<long>")


# --- exact comparison ----------------------------------------------------------------------------

def _texts(docs: DataFrame, owners: DataFrame, needed: DataFrame) -> DataFrame:
    """set_id, text of the sets in ``needed`` (one column); ``owners`` names a row of ``docs`` for each."""
    needed = needed.toDF("_set").distinct().join(owners, F.col("_set") == F.col("set_id")).select(
        "set_id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return materialise(rows.join(needed.hint("shuffle_hash"), same).select("set_id", "text").dropDuplicates(["set_id"]), "set-texts")


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def verified(docs: DataFrame, owners: DataFrame, pairs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of set ids that link."""
    pairs = materialise(pairs.select("a", "b"), "pairs")
    texts = _texts(docs, owners, pairs.select("a").union(pairs.select("b")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in batches_of_texts(batch, 2):
                sets = zip(shingle_sets(some.column(2), words), shingle_sets(some.column(3), words))
                links = [linked(x, y, threshold) for x, y in sets]
                yield some.select([0, 1]).filter(pa.array(links, pa.bool_()))

    both = (
        pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return both.mapInArrow(compare, "a long, b long")


def opened(docs: DataFrame, owners: DataFrame, asking: DataFrame, members: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links (a, b) between the classes that ask for a group and its members, enough to connect them.

    A row of the comparison is a group with a block of those that ask, about ``GROUP_SIZE`` each, so pairs
    are not written out; pairs already connected within the row are passed over.
    """
    asking = materialise(asking.select("a", "group"), "asking")
    blocks = asking.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (2 * GROUP_SIZE)).alias("parts"))
    members = members.join(asking.select("group").distinct(), "group").select("set_id", "group")
    texts = _texts(docs, owners, asking.select("a").union(members.select("set_id")))
    held = members.join(texts, "set_id").groupBy("group").agg(F.collect_list("set_id").alias("b"), F.collect_list("text").alias("texts_b"))
    rows = (
        asking.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("a", F.lit(7)), F.col("parts")))
        .join(texts, F.col("a") == F.col("set_id")).groupBy("group", "block")
        .agg(F.collect_list("a").alias("a"), F.collect_list("text").alias("texts_a"))
        .join(held, "group").select("a", "texts_a", "b", "texts_b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for row in range(batch.num_rows):
                ids = [batch.column(i)[row].as_py() for i in (0, 2)]
                sets = [list(shingle_sets(batch.column(i)[row].values, words)) for i in (1, 3)]
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for a, x in zip(ids[0], sets[0]):
                    for b, y in zip(ids[1], sets[1]):
                        if 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)) and find(a) != find(b) and linked(x, y, threshold):
                            root[find(a)] = find(b)
                            left.append(a)
                            right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _least_needed(n: Column, m: Column, threshold: int) -> Column:
    """Smallest intersection with which sets of n and m tokens link."""
    return F.ceil(F.lit(threshold) * (n + m) / F.lit(100.0 + threshold) - 1e-9)


def _most_shared(shared: Column, n: Column, m: Column, threshold: int) -> Column:
    """No more tokens are common than the shared prefix tokens and the longer rest behind a prefix."""
    return shared + F.ceil(F.lit(threshold) * F.greatest(n, m) / 100.0 - 1e-9) - 1


# --- components -----------------------------------------------------------------------------------

def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """node, component (its smallest node) of all nodes with a link; ``links`` has a and b.

    Each round, every node takes the smallest label among its neighbours' labels and then its label's
    label. Labels are stored between rounds; the number of rounds grows with the logarithm of
    the longest chain, and two tables of the links' size are shuffled in each.
    """
    edges = materialise(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), name)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        # A root that hears of a smaller label passes it to all that point at it.
        roots = closer.groupBy(F.col("old").alias("root")).agg(F.min("component").alias("least"))
        stepped = materialise(
            closer.join(roots, closer["old"] == roots["root"]).select(
                "node", "old", F.least("component", "least").alias("component")
            ), name,
        )
        onward = stepped.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = materialise(
            stepped.join(onward, stepped["component"] == onward["via"], "left").select(
                "node", "old", F.least("component", "further").alias("component")
            ), name,
        )
        labels = new.select("node", "component")
        if new.filter(F.col("component") != F.col("old")).isEmpty():
            return labels


# --- the join -------------------------------------------------------------------------------------

def _likely(met: DataFrame, threshold: int) -> DataFrame:
    """From set_id, n, first: for each class the partner met most often, if that is often enough."""
    best = met.groupBy("set_id", "first", "n").agg(F.count(F.lit(1)).alias("times")).groupBy("set_id", "n").agg(
        F.max(F.struct("times", "first")).alias("best")
    )
    enough = F.col("best.times") * 3 >= F.col("n") * (100 - threshold) / 100.0
    return best.filter(enough).select(F.col("set_id").alias("a"), F.col("best.first").alias("b"))


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``shared`` with component, for the tokens that classes of several components have."""
    placed = shared.join(labels, shared["set_id"] == labels["node"], "left").select(
        *shared.columns, F.coalesce("component", "set_id").alias("component")
    )
    several = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("token")
    return materialise(placed.join(several, "token"), "mixed-tokens")


def _next_partners(mixed: DataFrame) -> DataFrame:
    """set_id, n, first: for each token the most central class of another component."""
    tops = mixed.groupBy("token", "component").agg(F.max_by("set_id", "centre").alias("top"), F.max("centre").alias("centre"))
    order = Window.partitionBy("token").orderBy(F.desc("centre"), "component")
    tops = tops.withColumn("_r", F.row_number().over(order)).filter("_r <= 2").groupBy("token").agg(
        *[F.max(F.when(F.col("_r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("top", "component")]
    )
    other = F.when(F.col("component") != F.col("component1"), F.col("top1")).otherwise(F.col("top2"))
    return mixed.join(tops, "token").select("set_id", "n", other.alias("first"))


def _groups(mixed: DataFrame, partners: DataFrame) -> DataFrame:
    """set_id, n, own (size and id of its component) and group of every class.

    A group is a part of a component, or of the single classes that have one likely partner's component
    in common, of similar sizes, about ``GROUP_SIZE`` classes.
    """
    members = mixed.select("set_id", "n", "component").distinct()
    weights = members.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    near = partners.select(F.col("a").alias("set_id"), "b").join(
        members.select(F.col("set_id").alias("b"), F.col("component").alias("near")), "b"
    ).select("set_id", "near")
    family = F.when(F.col("weight") > 1, F.col("component")).otherwise(F.coalesce("near", "component"))
    placed = members.join(weights, "component").join(near, "set_id", "left").withColumns({
        "family": family, "single": F.col("weight") == 1, "band": F.floor(F.log(F.col("n").cast("double")) * 25),
    })
    key = ["family", "single", "band"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / GROUP_SIZE).alias("parts"))
    return materialise(placed.join(parts, key).select(
        "set_id", "n", F.struct("weight", "component").alias("own"),
        F.xxhash64(*key, F.pmod(F.xxhash64("set_id"), F.col("parts"))).alias("group"),
    ), "group-members")


def _asking(mixed: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """a, group: the classes and groups whose bound reaches what a link needs.

    A class asks the groups that hold a component no smaller than its own, and another one; so of two
    classes of different components one asks for the other's group.
    """
    about = members.groupBy("group").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("own").alias("most"), F.min("own").alias("least")
    )
    known = mixed.select("token", "pos", "set_id").join(members, "set_id")
    matrix = known.groupBy("token", "group").agg(F.min("pos").alias("pos_g")).join(about, "group")
    low = F.greatest(F.col("low"), F.ceil(F.col("n") * threshold / 100.0 - 1e-9))
    high = F.least(F.col("high"), F.floor(F.col("n") * 100.0 / threshold + 1e-9))
    asks = (F.col("own") <= F.col("most")) & ~((F.col("own") == F.col("least")) & (F.col("own") == F.col("most")))
    # Sets that link share one of their first (size - least intersection + 1) tokens.
    early = (F.col("pos") <= F.col("n") - _least_needed(F.col("n"), low, threshold)) & (
        F.col("pos_g") <= high - _least_needed(F.col("n"), high, threshold)
    )
    met = materialise(
        known.select("token", "pos", F.col("set_id").alias("a"), "n", "own").join(matrix, "token")
        .filter(asks & (low <= high) & early).select("a", "group").distinct(), "met-groups",
    )
    unions = matrix.groupBy("group", "low", "high").agg(F.collect_list("token").alias("union"))
    queries = known.groupBy(F.col("set_id").alias("a"), "n").agg(F.collect_list("token").alias("tokens"))
    shared = F.size(F.array_intersect("tokens", "union"))
    return (
        met.join(queries, "a").join(unions, "group")
        .filter(_most_shared(shared, F.col("n"), high, threshold) >= _least_needed(F.col("n"), low, threshold)).select("a", "group")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS_PER_SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Shingles have ``words`` words, and a link needs 100 * intersection >= ``threshold`` * union.

    Links between classes are found in two steps. The first compares each class with one likely
    partner, twice, and joins what links into components, so that a large family of copies costs
    two comparisons a member. The second, which makes the result complete, looks through the matrix for
    groups of other components only.

    A null or empty text, or one without words, has no shingles, links with nothing and has its own
    doc_id as component. Equal rows, also under one id, are one class. Null ids take part and are
    never the smallest unless all are null. An empty table gives no rows. Set ids and shingles
    are 64-bit hashes.
    """
    sets = materialise(token_sets(docs, words, threshold), "token-sets")
    owners = materialise(
        sets.filter("set_id IS NOT NULL").groupBy("set_id").agg(
            F.min(F.struct("doc_id", "text_key")).alias("row"), F.min("doc_id").alias("least")
        ).select("set_id", "row.doc_id", "row.text_key", "least"), "set-owners",
    )
    postings = (
        sets.join(owners.select("set_id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "set_id")
        .filter(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        .dropDuplicates(["set_id"])
        .select("set_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    )
    postings = materialise(postings, "postings")
    tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = materialise(postings.join(tokens, "token"), "shared-tokens")
    # The class whose tokens are the most common is the one most others can link with.
    spread = F.shiftleft(F.sum("often"), 20) + F.pmod(F.xxhash64("set_id"), F.lit(1 << 20))
    centres = shared.groupBy("set_id").agg(spread.alias("centre"))
    shared = materialise(shared.join(centres, "set_id").select("token", "pos", "set_id", "n", "centre"), "shared-tokens")
    firsts = shared.groupBy("token").agg(F.max_by("set_id", "centre").alias("first"))
    met = shared.join(firsts, "token").filter(F.col("set_id") != F.col("first"))
    links = materialise(verified(docs, owners, _likely(met, threshold), words, threshold), "links")
    mixed = _mixed(shared, components(links, "first-labels"))
    partners = materialise(_likely(_next_partners(mixed), threshold), "partners")
    links = links.union(materialise(verified(docs, owners, partners, words, threshold), "links"))
    mixed = _mixed(mixed.drop("component"), components(links, "first-labels"))
    members = _groups(mixed, partners)
    more = materialise(opened(docs, owners, _asking(mixed, members, threshold), members, words, threshold), "links")
    labels = components(links.union(more), "labels")
    classes = owners.select("set_id", "least").join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "least", F.coalesce("component", "set_id").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("set_id", "component", "component_id")
    return sets.join(named, "set_id", "left").select(
        "doc_id", "text_key", "component", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = WORDS_PER_SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns stay.

    Rows without shingles all stay. Of equal rows with one id, one stays. Null ids come last.
    """
    docs, back = set_aside(docs, ("doc_id", "text"))
    found = materialise(near_duplicates(docs, words, threshold), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("row")).select("row.doc_id", "row.text_key")
    empty = found.filter("component IS NULL").select("doc_id", "text_key").distinct()
    stays = first.withColumn("_single", F.lit(True)).unionByName(empty.withColumn("_single", F.lit(False))).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_single"
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    kept = docs.join(stays.hint("shuffle_hash"), same)
    equal = found.filter("component IS NOT NULL").groupBy("doc_id", "text_key").count().filter("count > 1")
    if not equal.isEmpty():  # physical only: without equal rows there is nothing to choose
        several = kept.filter("_single").dropDuplicates(["_id", "_key"])
        kept = several.unionByName(kept.filter("NOT _single"))
    return kept.select(*docs.columns).withColumnsRenamed(back)
