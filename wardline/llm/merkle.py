"""A manifest of a dataset as a Merkle DAG, and the proofs of its rows by descent from the root.

A row's leaf is a digest of its fields, each written as its length in bytes, a colon and its value, or as a dash for
null. The leaves of a group (a source) stand in key order; every 16 neighbours, and the last run of fewer, become
the digest of their digests, until one is left: the group's subroot. The subroots, in the order of their groups
(null first, then by UTF-8 bytes), make the root in the same way. Digests are SHA-256; what is hashed is their
lower-case hexadecimal text, what is stored are their 32 bytes.

`build` stores one record per distinct inner digest: the digest and its children's digests in a row. `prove` starts
at the root and descends: each step looks the digests reached up in the records, goes on to the children that
requests ask for, as the digits to base 16 of their ranks say, and adds the children that it leaves aside to the
path, left and right apart. At the leaves the path is reversed: from then on it leads up to the root. A step's rows
are the distinct prefixes of ranks, not the requests, so the root's record is read once however many rows are asked
for, and paths go through shuffles once per run of 16 leaves. `fold` recomputes the root from a leaf and a path.

Ranks come from one range sort, so that a group which holds most rows is dealt over many tasks: a row's rank is its
place in its partition and the sizes of its group's parts in the partitions before. A window with one row per
partition and group adds those up.

Results: one row per input row. Rows with equal keys in a group stand in the order of their leaves; null keys come
first. A group of one row has its leaf as subroot; a single group has its subroot as root. Without rows there is no
root and no result. Other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.keys import same_keys
from wardline.llm.common import Scratch

#: Children of a node, as a power of two.
FAN_BITS = 4
FAN = 1 << FAN_BITS
SIZE = 32


def leaf_digest(*fields: Column) -> Column:
    """The 32 bytes of a row's leaf."""
    written = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[written(c.cast("string")) for c in fields]), 256))


def hexed(digests: Column) -> Column:
    """Digests as they are hashed and shown."""
    return F.lower(F.hex(digests))


def fold(leaf: Column, path: Column) -> Column:
    """The root, as text, that a leaf and a path from it upwards lead to."""
    return F.aggregate(
        path, hexed(leaf), lambda below, step: F.sha2(F.concat(hexed(step["left"]), below, hexed(step["right"])), 256)
    )


def siblings_digest(path: Column) -> Column:
    """The digest, as text, of all siblings on a path from a leaf upwards, left to right on each level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""), 256)


@dataclass
class Manifest:
    """A stored DAG: its root, the records of inner nodes (digest, children), the runs of up to 16 leaves (tree, size, run,
    rows: array of rank, key, digest, claim), and the groups (group, tree, size). Trees are groups by rank."""

    root: bytes | None
    records: DataFrame
    runs: DataFrame
    groups: DataFrame
    scratch: Scratch


def _ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows with `rank` (from 0, in their group) and `total` (rows of their group)."""
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = scratch.stage(
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        name,
    )
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*group)
    before = F.sum("_n").over(inside.orderBy("_part")) - F.col("_n")
    parts = parts.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(inside).alias("total"))
    joined = placed.alias("l").join(parts.alias("r"), same_keys("l", "r", [*group, "_part"]))
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_at") + F.col("_shift")).alias("rank"), "total")


def _children(listed: Column) -> Column:
    """The digests of an array of (rank, ..., digest) structs, in a row."""
    return F.unhex(F.array_join(F.transform(listed, lambda x: F.hex(x["digest"])), ""))


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above (tree, size, rank, digest), with its children; size is that of the tree's level."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "digest")))
    grouped = nodes.groupBy("tree", "size", F.shiftright("rank", FAN_BITS).alias("above")).agg(listed.alias("listed"))
    return _closed(grouped.select("tree", "size", F.col("above").alias("rank"), _children(F.col("listed")).alias("children")))


def _closed(nodes: DataFrame) -> DataFrame:
    own = F.unhex(F.sha2(hexed(F.col("children")), 256))
    return nodes.select("tree", _above("size").alias("size"), "rank", own.alias("digest"), "children")


def _above(size: str) -> Column:
    return F.shiftright(F.col(size) + (FAN - 1), FAN_BITS)


def _climb(level: DataFrame, most: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels from a staged one up to trees of one node, and those last nodes (tree, digest). `most` is the size of
    the largest tree's staged level."""
    levels = [level]
    while most > 1:
        level = scratch.stage(_parents(level.where("size > 1")), f"{name}-{len(levels)}")
        most = -(-most // FAN)
        levels.append(level)
    tops = reduce(DataFrame.unionByName, [v.where("size = 1").select("tree", "digest") for v in levels])
    return levels, tops


def build(rows: DataFrame, key: str = "key", group: str = "group", leaf: str = "leaf", claim: str | None = None) -> Manifest:
    """Store the DAG of a table of leaves. `claim` names a column of other leaves that proofs are to be tried on; they are
    carried along with their rows."""
    scratch = Scratch(rows.sparkSession, "manifest")
    narrow = rows.select(
        F.col(key).alias("key"), F.col(group).alias("group"), F.col(leaf).alias("digest"),
        (F.lit(None).cast("binary") if claim is None else F.col(claim)).alias("claim"),
    )
    ranked = _ranked(narrow, ["group"], ["key", "digest"], scratch, "leaves")
    sizes = ranked.where("rank = 0").select("group", F.col("total").alias("size"))
    groups = scratch.stage(_ranked(sizes, [], ["group"], scratch, "sizes").select("group", F.col("rank").alias("tree"), "size"), "groups")
    most, n_groups = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    numbered = ranked.alias("l").join(groups.alias("r"), same_keys("l", "r", ["group"]))
    listed = F.array_sort(F.collect_list(F.struct("rank", "key", "digest", "claim")))
    runs = scratch.stage(
        numbered.groupBy("tree", "size", F.shiftright("rank", FAN_BITS).alias("run")).agg(listed.alias("rows")), "runs"
    )
    if not n_groups:
        none = rows.sparkSession.createDataFrame([], "digest binary, children binary")
        return Manifest(None, none, runs, groups, scratch)
    first = runs.where("size > 1").select("tree", "size", F.col("run").alias("rank"), _children(F.col("rows")).alias("children"))
    levels, tops = _climb(scratch.stage(_closed(first), "level-0"), -(-most // FAN), scratch, "level")
    lone = runs.where("size = 1").select("tree", F.col("rows")[0]["digest"].alias("digest"))
    subroots = scratch.stage(
        tops.unionByName(lone).select(
            F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("size"), F.col("tree").alias("rank"), "digest",
            F.lit(None).cast("binary").alias("children"),
        ),
        "subroots",
    )
    upper, top = _climb(subroots, n_groups, scratch, "upper")
    root = bytes(top.first()["digest"])
    inner = [v.select("digest", "children") for v in [*levels, *upper[1:]]]
    records = scratch.stage(reduce(DataFrame.unionByName, inner).dropDuplicates(["digest"]), "records")
    return Manifest(root, records, runs, groups, scratch)


def _depth(size: Column) -> Column:
    """Levels below the top of a tree of so many leaves."""
    return reduce(lambda a, b: a + b, [(size > F.lit(1 << k)).cast("int") for k in range(0, 60, FAN_BITS)])


def _descend(reached: DataFrame, records: DataFrame, wanted: DataFrame | None, left: int) -> DataFrame:
    """One level down (tree, rank, digest, path, ...): the wanted children, `left` levels above the leaves' ranks, with
    those left aside added to the path."""
    at = F.col("digit")
    below = (
        reached.join(records, "digest")
        .withColumn("digit", F.explode(F.sequence(F.lit(0), (F.octet_length("children") / SIZE).cast("int") - 1)))
        .withColumn("rank", F.shiftleft("rank", FAN_BITS) + at)
        .withColumn("path", F.array_append("path", _step(F.col("children"), at)))
        .withColumn("digest", _child(F.col("children"), at))
    )
    if wanted is not None:
        prefixes = wanted.select("tree", F.shiftright("rank", FAN_BITS * left).alias("rank")).distinct()
        below = below.join(prefixes, ["tree", "rank"], "left_semi")
    return below.select(*reached.columns)


def _child(children: Column, at: Column) -> Column:
    return F.substring(children, at * SIZE + 1, F.lit(SIZE))


def _step(children: Column, at: Column) -> Column:
    """What stands left and right of a child."""
    right = F.substring(children, (at + 1) * SIZE + 1, F.octet_length(children))
    return F.struct(F.substring(children, F.lit(1), at * SIZE).alias("left"), right.alias("right"))


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(key, leaf, claim, subroot, path) per row: the path holds the siblings left and right, from the leaf up to the root.

    `wanted` (tree, rank) asks for the rows of these ranks in these groups only.
    """
    groups, scratch, records = manifest.groups, manifest.scratch, manifest.records
    spark = groups.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], _proof_schema(manifest))
    n_groups = groups.count()
    deepest = groups.select(F.max(_depth(F.col("size")))).first()[0]
    upper = None if wanted is None else wanted.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"))
    reached = spark.createDataFrame([(0, 0, manifest.root, [])], f"tree long, rank long, digest binary, path {_PATH}")
    for left in reversed(range(sum(n_groups > FAN ** k for k in range(15)))):
        reached = _descend(reached, records, upper, left)
    tops = scratch.stage(
        reached.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot"))
        .join(groups.select("tree", _depth(F.col("size")).alias("depth")), "tree"),
        f"tops-{uuid.uuid4().hex}",
    )
    at_depth = lambda d: tops.where(F.col("depth") == d).drop("depth")
    now = at_depth(deepest)
    for depth in range(deepest, 1, -1):
        now = _descend(now, records, wanted, depth - 1).unionByName(at_depth(depth - 1))
    runs = manifest.runs.select("tree", F.col("run").alias("rank"), "rows")
    steps = now.join(records, "digest").join(runs, ["tree", "rank"]) if deepest else None
    digit = F.col("row.rank").bitwiseAND(FAN - 1).cast("int")
    asked = lambda df: df if wanted is None else df.join(
        wanted.distinct(), (df["tree"] == wanted["tree"]) & (df["row.rank"] == wanted["rank"]), "left_semi")
    lone = at_depth(0).join(runs, ["tree", "rank"]).withColumn("row", F.explode("rows"))
    found = asked(lone).select("row", "subroot", "path")
    if steps is not None:
        deep = asked(steps.withColumn("row", F.explode("rows")))
        found = found.unionByName(deep.select("row", "subroot", F.array_append("path", _step(F.col("children"), digit)).alias("path")))
    return found.select(
        F.col("row.key").alias("key"), F.col("row.digest").alias("leaf"), F.col("row.claim").alias("claim"), "subroot",
        F.reverse("path").alias("path"),
    )


_PATH = "array<struct<left: binary, right: binary>>"


def _proof_schema(manifest: Manifest) -> str:
    key = manifest.runs.schema["rows"].dataType.elementType["key"].dataType.simpleString()
    return f"key {key}, leaf binary, claim binary, subroot binary, path {_PATH}"
