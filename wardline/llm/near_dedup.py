"""Near-duplicate documents by SuperMinHash, banding, verification and grouping.

A document is the set of its word shingles. SuperMinHash walks each shingle through a pseudo-random permutation of the
signature's slots: at step j the shingle offers j plus a random fraction to the slot its permutation names, and each
slot keeps the least offer. The ranks of one shingle are correlated, so each slot is met once, which lowers the
variance; a step can only help while some slot holds more than j, so all shingles stop early.

Documents with equal sets are one node from there on. Nodes that agree in a band of slots are candidates. Each band
bucket has two centres, the node that shares the most buckets with others and the one with the smallest key. A node is
compared with the centre that it shares most bands with, then with its other centres that are not yet in its component;
links are confirmed on the full sets. Last come the pairs of one bucket that are still in different components: those
with a rare shingle in common (one that at most 8 nodes have) meet on it; all others are compared unless the numbers
of their rare shingles, which are then outside the intersection, rule the link out. So every pair of candidates is either confirmed,
refuted, or joined by other links; no bucket is capped, and copies are never paired within a group.

Results: one row per input row. Texts that are null, empty or white space have no set and link with nothing; those
with fewer words than a shingle are one shingle. Rows with equal keys stay rows of their own and share a component
if their sets are linked; a null key counts after all others. No rows give none. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, WordHashes, alone, map_batches, row_numbers, shingle_hashes, spaced_words
from wardline.llm.components import components

SLOTS = 120
#: A shingle that at most so many nodes have is rare; nodes meet on each of their rare shingles.
RARE = 8
_HASHES = WordHashes()
_STEP = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FREE = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of a set of 64-bit hashes: per slot the least of step * 2**48 + fraction * 2**48."""
    held = np.full(slots, _FREE, np.uint64)
    order = None
    for j in range(slots):
        if held.max() <= np.uint64(j << 48):
            break
        drawn = _mix(elements + np.uint64(_STEP * (j + 1) % (1 << 64)))
        k = j + (drawn & np.uint64(0xFFFF)).astype(np.int64) % (slots - j)
        offer = (drawn >> np.uint64(16)) | np.uint64(j << 48)
        if j == 0:
            place = k
            first = k
        else:
            if order is None:
                order = np.broadcast_to(np.arange(slots, dtype=np.int16), (len(elements), slots)).copy()
                rows = np.arange(len(elements))
                order[rows, first], order[:, 0] = 0, first
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(held, place, offer)
    return held


def bands_for(threshold: float, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, slots in each): the widest bands that miss a pair at the threshold at most once in 10 000."""
    for width in range(slots, 0, -1):
        if slots % width == 0 and (1 - threshold**width) ** (slots // width) <= 1e-4:
            return slots // width, width
    return slots, 1


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    own = _HASHES.of(spaced_words(text))
    return np.unique(shingle_hashes(own, min(words, len(own)))) if len(own) else np.empty(0, np.uint64)


def _digest(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def sketch(docs: DataFrame, words: int, threshold: float, key: str, text: str) -> DataFrame:
    """(row, key, n, node, bands) per document: node names its set; bands are hashes of the signature's bands."""
    import xxhash

    n_bands, width = bands_for(threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near", _HASHES.clear)
        first, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for data in batch.column(1).to_pylist():
                own = shingle_set(data, words)
                sizes.append(len(own))
                nodes.append(_digest(own) if len(own) else None)
                slots = signature(own).reshape(n_bands, width) if len(own) else ()
                bands.append([xxhash.xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(slots)])
            rows = row_numbers(first, len(sizes), part)
            first += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "key", "n", "node", "bands"],
            )

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("data"))
    return map_batches(own, work, f"row long, key {kind}, n long, node binary, bands array<long>")


def _bits(keys: DataFrame, bits: int = 26) -> np.ndarray:
    """A bit table of fixed size (8 MB) that holds the hashes of a column `h`."""
    place = F.shiftrightunsigned("h", 64 - bits)
    found = (
        keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("mask")).toPandas()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.word.to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return table


def _sets(docs: DataFrame, needed: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(node, items binary) of the nodes in `needed` (node, key): their texts are read again, the others left out by a
    bit table over the keys."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits(needed.select(F.xxhash64("key").alias("h"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near", _HASHES.clear)
        bits = sent.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(38)
            hit = ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            nodes, items = [], []
            for data in batch.column(1).filter(pa.array(hit)).to_pylist():
                own = shingle_set(data, words)
                if len(own):
                    nodes.append(_digest(own))
                    items.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(items, pa.binary())], ["node", "items"])

    own = docs.select(F.xxhash64(key).alias("h"), F.col(text).cast("binary").alias("data"))
    return map_batches(own, work, "node binary, items binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(left) > len(right):
                    left, right = right, left
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                both = int((right[at] == left).sum())
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    full = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    )
    return map_batches(full.select("a", "b", "x", "y"), work, "a binary, b binary")


def _shingles(sets: DataFrame) -> DataFrame:
    """(id, item) for each shingle of each node (id, items)."""

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(items.as_buffer(), np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node, np.int64)), pa.array(part)], ["id", "item"])

    return map_batches(sets.select("id", "items"), spill, "id long, item long")


def find(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n_shingles, component_id, chosen) per row: component_id is the smallest key that links reach, and
    `chosen` marks the one row of each component that stays."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.stage(sketch(docs, words, percent / 100, key, text), "rows")
    low = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("low")
    nodes = scratch.stage(
        rows.where("n > 0").groupBy("node").agg(low, F.first("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes"
    )
    member = nodes.select("node", "n", "low", F.explode("bands").alias("band"))
    shared = scratch.stage(member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    inside = scratch.stage(member.join(shared, "band"), "inside")  # the members of buckets with company
    nodes = scratch.stage(nodes.select("node", "low", "copies"), "members")
    scratch.drop("nodes")  # the bands of nodes without company are not read again
    weight = inside.groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = inside.join(weight, "node")
    centres = ranked.groupBy("band").agg(
        F.max_by(F.struct("node", "n"), F.struct("weight", "n", "node")).alias("top"),
        F.min_by(F.struct("node", "n"), F.struct("low", "node")).alias("first"),
    )
    centres = scratch.stage(centres, "centres")
    near = lambda n, m: (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    told = ranked.join(centres, "band").select("node", "n", "weight", F.explode(F.array("top", "first")).alias("c"))
    stars = told.where((F.col("node") != F.col("c.node")) & near(F.col("n"), F.col("c.n")))
    stars = scratch.stage(stars.groupBy("node", F.col("c.node").alias("centre")).agg(F.count("*").alias("shared")), "stars")
    # whatever may be compared is in a shared bucket
    needed = inside.select("node", F.col("low.key").alias("key")).distinct()
    sets = scratch.stage(_sets(docs, needed, words, key, text).dropDuplicates(["node"]).join(needed.select("node"), "node", "left_semi"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.stage(_confirm(pairs, sets, percent), name)

    # each node with the centre that it shares most bands with, then with the others that are not yet joined to it
    best = stars.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    first = scratch.stage(best.select(*pair(F.col("node"), F.col("centre"))).distinct(), "first")
    links = confirmed(first, "links1")
    roots = scratch.stage(components(links, scratch, "a"), "roots1")
    apart = lambda df, x, y: (
        df.join(roots.select(F.col("node").alias(x), F.col("root").alias("rx")), x, "left")
        .join(roots.select(F.col("node").alias(y), F.col("root").alias("ry")), y, "left")
        .where(F.coalesce("rx", x) != F.coalesce("ry", y)).drop("rx", "ry")
    )
    second = scratch.stage(apart(stars, "node", "centre").select(*pair(F.col("node"), F.col("centre"))).distinct().join(first, ["a", "b"], "left_anti"), "second")
    links = links.unionByName(confirmed(second, "links2"))
    roots = scratch.stage(components(links, scratch, "b"), "roots2")
    # then all pairs of one bucket in different components
    placed = inside.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    placed = scratch.stage(placed, "placed")
    for name in ("inside", "shared", "centres", "stars"):
        scratch.drop(name)
    mixed = placed.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("band")
    open_ = scratch.stage(placed.join(mixed, "band", "left_semi"), "open")
    info = open_.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list("band")).alias("bands"))  # a signature's bands at most
    info = scratch.stage(info.withColumn("id", F.monotonically_increasing_id()), "info")
    each = scratch.stage(_shingles(sets.join(info.select("node", "id"), "node")), "each")
    few = each.groupBy("item").agg(F.count("*").alias("holders")).where(F.col("holders") <= RARE)
    rare = scratch.stage(each.join(few, "item").select("id", "item"), "rare")
    scratch.drop("each")
    held = info.join(rare.groupBy("id").agg(F.count("*").alias("rare")), "id", "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    # two nodes without a rare shingle in common have their rare ones outside the intersection
    able = scratch.stage(held.where((F.col("n") - F.col("rare")) * 100 >= F.col("n") * percent), "able")
    twice = lambda df: df.select(*[F.col(c).alias(c if c == "band" else f"{c}_") for c in df.columns])
    placed_able = able.select(F.explode("bands").alias("band"), "node", "n", "root", "rare", "bands")
    most = F.least(F.col("n") - F.col("rare"), F.col("n_") - F.col("rare_"))
    # two nodes meet in the first of the bands that they share
    once = F.array_min(F.array_intersect("bands", "bands_")) == F.col("band")
    bounded = (
        placed_able.join(twice(placed_able), "band")
        .where((F.col("node") < F.col("node_")) & (F.col("root") != F.col("root_")) & (most * 100 >= (F.col("n") + F.col("n_") - most) * percent) & once)
        .select("node", "node_")
    )
    holders = rare.join(info.drop("bands"), "id")
    sharing = (
        holders.alias("l").join(holders.alias("r"), F.col("l.item") == F.col("r.item"))
        .where((F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & near(F.col("l.n"), F.col("r.n")))
        .select("l.node", F.col("r.node").alias("node_"))
    )
    rest = (
        bounded.unionByName(sharing).select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct()
        .join(first.unionByName(second), ["a", "b"], "left_anti")
    )
    more = confirmed(scratch.stage(rest, "rest"), "links3")
    if not more.isEmpty():
        roots = scratch.stage(components(links.unionByName(more), scratch, "c"), "roots3")
    # the component of each node that copies or links put into one
    linked = nodes.select("node", "low", "copies").join(roots, "node", "left")
    linked = linked.where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    lows = linked.groupBy("root").agg(F.min("low").alias("least"))
    told = scratch.stage(linked.select("node", "root").join(lows, "root").select("node", "least"), "told")
    for name in ("sets", "placed", "open", "info", "rare", "able", "members"):
        scratch.drop(name)
    return rows.select("row", "key", "n", "node").join(told, "node", "left").select(
        F.col("key").alias(key), "row", F.col("n").alias("n_shingles"),
        F.when(F.col("least").isNull(), F.col("key")).otherwise(F.col("least.key")).alias("component_id"),
        F.when(F.col("least").isNull(), F.lit(True)).otherwise(F.col("least.row") == F.col("row")).alias("chosen"),
    )


def apply(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns, one row of each component: that with the smallest key, the first such row in the input."""
    scratch = Scratch(docs.sparkSession, "near-rows")
    staged = scratch.stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    ranked = staged.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row")).alias("__rank"), F.col(text).alias("__text"))
    found = find(ranked, words, percent, key="__rank", text="__text")
    gone = found.where(~F.col("chosen")).select(F.col("__rank.row").alias("__row"))
    return staged.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
