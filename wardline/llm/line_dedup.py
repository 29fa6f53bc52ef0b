"""Repeated lines across documents, by a segment-partition edit join.

Lines are compared in lower case (A-Z) with white space runs as one space. Lines with fewer than `min_chars` characters
stay as they are; lines of at least `near_chars` characters are copies if at most `edits` characters are put in,
taken out or changed, shorter ones if they are equal. Copies of copies are one class; of each class only the first
line stays, in the order of keys, rows and lines.

A line is cut into edits + 1 segments of even length. Two lines within the edits share a segment, at a place that the
difference of their lengths bounds; so the segments are the index keys, and the substrings at the places that the
lengths allow (the multi-match-aware windows) are the probe keys. Keys that lines with different texts share are
counted first, in one pass that shuffles hashes only, and go into a bit table of fixed size (8 MB); the second pass
keeps the lines that have such a key, mostly few. These meet on their keys, first with one centre in each bucket and
then across the components formed so far, each two of a bucket once, under bounds on their letter counts and on the signs of
their bigrams; each pair left is verified by a bit-parallel automaton over the band of 2 * edits + 1 diagonals. Equal
lines are one line throughout, so they make no pairs.

Results: one row per input row. Null and empty texts have no lines to drop. A null key comes after all others, and rows
with equal keys are ordered by their place in the input. No rows give none. Other columns are kept by `apply` and
play no part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, batch_rows, map_batches
from wardline.llm.components import components

TABLE_BITS = 26


def normal(line: str) -> str:
    return " ".join(line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").split())


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of even segments; the later ones take what is left over."""
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        end = at + base + (i >= parts - more)
        out.append((at, end))
        at = end
    return out


def places(length: int, edits: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, end, whether it is a segment of the line's own) of all keys of a line."""
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        gap = length - other
        for i, (a, b) in enumerate(cuts(other, edits + 1)):
            low = max(a - i, a + gap - (edits - i), 0)
            high = min(a + i, a + gap + (edits - i), length - (b - a))
            out += [(other, i, p, p + b - a, gap == 0 and p == a) for p in range(low, high + 1)]
    return out


def _hasher(edits: int):
    """A function of normal lines that gives the unsigned hashes of all their keys, which of them index a line, and the number of keys
    of each line. Hashes of substrings come from prefix sums over the code points, for all lines of a call at once."""
    held: dict = {"places": {}, "powers": np.ones(1, np.uint64), "inverses": np.ones(1, np.uint64)}
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def of_length(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        known = held["places"]
        if n not in known:
            if len(known) > 5000:
                known.clear()
            where = places(n, edits)
            start, end, seed = (np.array(x, np.int64) for x in ([p[2] for p in where], [p[3] for p in where], [p[0] * 8 + p[1] for p in where]))
            known[n] = start, end, seed.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.array([p[4] for p in where], bool)
        return known[n]

    def hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(line) for line in lines], np.int64)
        if not len(lines):
            return np.zeros(0, np.uint64), np.zeros(0, bool), sizes
        if len(held["powers"]) <= (longest := int(sizes.max())):
            for name, by in (("powers", base), ("inverses", inverse)):
                factors = np.full(2 * longest, by, np.uint64)
                factors[0] = 1
                held[name] = np.cumprod(factors, dtype=np.uint64)
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * held["powers"][np.arange(len(code)) - np.repeat(begin, sizes)], dtype=np.uint64, out=sums[1:])
        found = [of_length(n) for n in sizes.tolist()]
        n = np.array([len(f[0]) for f in found], np.int64)
        start, end, seed, own = (np.concatenate([f[k] for f in found]) for k in range(4))
        at = np.repeat(begin, n)
        mixed = (sums[at + end] - sums[at + start]) * held["inverses"][start] ^ seed
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(factor)
        return mixed ^ mixed >> np.uint64(29), own, n

    return hashes


_HASHERS: dict = {}


def keys(line: str, edits: int) -> tuple[list[int], list[bool]]:
    """Unsigned hashes of a normal line's keys, and which of them index it."""
    found, own, _ = _HASHERS.setdefault(edits, _hasher(edits))([line])
    return found.tolist(), own.tolist()


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines are within so many edits. One bit per diagonal of the band, one word per number of edits."""
    if abs(len(a) - len(b)) > edits:
        return False
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    if tail:
        a, b = a[:-tail], b[:-tail]
    full = (1 << (2 * edits + 1)) - 1
    states = [(1 << edits)]
    for _ in range(edits):
        states.append(states[-1] | states[-1] << 1 & full)
    padded = "\0" * edits + a + "\0" * (edits + max(0, len(b) - len(a)))
    for j, c in enumerate(b):
        match = 0
        at = padded.find(c, j, j + 2 * edits + 1)
        while at >= 0:
            match |= 1 << (at - j)
            at = padded.find(c, at + 1, j + 2 * edits + 1)
        before, states[0] = states[0], states[0] & match
        for e in range(1, edits + 1):
            held = states[e]
            states[e] = (held & match | before | before >> 1 | states[e - 1] << 1) & full
            before = held
        if not states[edits]:
            return False
    return bool(states[edits] >> (edits + len(a) - len(b)) & 1)


def letter_counts(line: str) -> int:
    """Eight counts of characters, by the low bits of their code points, modulo 256, in one signed 64-bit number."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(7)
    return int(np.bincount(code, minlength=8).astype(np.uint8).view(np.int64)[0])


def bigram_signs(line: str) -> list[int]:
    """Four signed 64-bit numbers: bit h tells whether an odd number of the line's bigrams have the 8-bit hash h. An edit takes
    out two bigrams at most and puts in two at most, so it turns at most four bits."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = (code[:-1] * np.uint32(0x9E3779B1) ^ code[1:]) * np.uint32(0x85EBCA77)
    odd = np.bincount((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(24), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _count_gap(x, y):
    """Sum of the differences of two letter counts, as a Column."""
    parts = [
        F.abs(((F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * k).bitwiseAND(F.lit(255)) + 384) % 256) - 128)
        for k in range(8)
    ]
    return sum(parts[1:], parts[0])


#: Two lines that meet, each pair alike whichever of them has asked.
_PAIR = ("least(node, node_) AS a", "greatest(node, node_) AS b")


def _bound(edits: int):
    """Whether sizes and sketches (letter counts, then bigram signs) leave two lines within the edits possible, as a Column."""
    x, y = F.col("sketch"), F.col("sketch_")
    turned = [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, 5)]
    return (F.abs(F.col("size") - F.col("size_")) <= edits) & (sum(turned[1:], turned[0]) <= 4 * edits) & (_count_gap(x[0], y[0]) <= 2 * edits)


def _across(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b) of lines (key, own, node, size, sketch, root) that meet on a key, are in different components and may be within
    the edits, once for each such key."""
    there = lines.where("own").select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "size", "sketch", "root")])
    once = ~F.col("own") | (F.col("node") < F.col("node_"))  # two lines that a key indexes would meet twice
    return lines.join(there, "key").where(once & (F.col("root") != F.col("root_")) & _bound(edits)).selectExpr(*_PAIR)


def _some_lines(batches: Iterator[pa.RecordBatch], long_enough: int, digest, seen: set) -> Iterator[tuple[list[str], list]]:
    """Normal lines of texts with their digests, some thousand at a time; most that have come before are left out."""
    lines, digests, held = [], [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                if len(line) >= long_enough and len(line := normal(line)) >= long_enough:
                    if (d := digest(line.encode("utf-8", "surrogatepass"))) in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(d)
                    lines.append(line)
                    digests.append(d)
                    held += len(line)
                    if held >= 1 << 18:
                        yield lines, digests
                        lines, digests, held = [], [], 0
    if lines:
        yield lines, digests


def _near(rows: DataFrame, scratch: Scratch, edits: int, near_chars: int) -> DataFrame:
    """(node, root) of the normal lines that are copies of lines with other texts."""
    import xxhash

    long_enough = max(near_chars, edits + 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _hasher(edits), set()
        for lines, line_of in _some_lines(batches, long_enough, xxhash.xxh3_64_intdigest, seen):
            found, own, n = hashes(lines)
            ids = np.repeat(np.array(line_of, np.uint64).view(np.int64), n)
            signed = found.view(np.int64)
            for at in range(0, len(found), 1 << 16):
                to = at + (1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed[at:to]), pa.array(ids[at:to]), pa.array(own[at:to])], ["key", "line", "own"]
                )

    shared = (
        map_batches(rows.select("text"), index, "key long, line long, own boolean")
        .groupBy("key").agg(F.min("line").alias("l1"), F.max("line").alias("l2"), F.max("own").alias("own"))
        .where("own AND l1 != l2")
    )
    place = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    words = (
        shared.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("mask")).toPandas()
    )
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return _match(rows, scratch, edits, long_enough, table)


def _match(rows: DataFrame, scratch: Scratch, edits: int, long_enough: int, table: np.ndarray) -> DataFrame:
    import xxhash

    sent = rows.sparkSession.sparkContext.broadcast(table)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, keyed, seen = sent.value, _hasher(edits), set()
        for lines, nodes in _some_lines(batches, long_enough, xxhash.xxh3_128_digest, seen):
            hashes, own, n = keyed(lines)
            at = hashes >> np.uint64(64 - TABLE_BITS)
            hit = ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            ends = np.cumsum(n, dtype=np.int64)
            before = np.concatenate(([0], np.cumsum(hit)))
            signed = hashes.view(np.int64)
            out: list[list] = [[], [], [], [], []]
            for k in np.flatnonzero(before[ends] > before[ends - n]) if lines else ():
                line = lines[k]
                out[0].append(nodes[k])
                out[1].append(line)
                out[2].append(len(line))
                out[3].append([letter_counts(line), *bigram_signs(line)])
                out[4].append([{"key": int(signed[j]), "own": bool(own[j])} for j in range(ends[k] - n[k], ends[k]) if hit[j]])
            kinds = [pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("key", pa.int64()), ("own", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["node", "line", "size", "sketch", "keys"])

    schema = "node binary, line string, size int, sketch array<long>, keys array<struct<key: long, own: boolean>>"
    lines = scratch.stage(map_batches(rows.select("text"), probe, schema).dropDuplicates(["node"]), "lines")
    keyed = lines.select("node", "size", "sketch", F.explode("keys").alias("k")).select("k.key", "k.own", "node", "size", "sketch")
    indexed = keyed.where("own").select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "size", "sketch")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        full = (
            pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a")
            .join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        )
        with batch_rows(rows.sparkSession, 512):
            return scratch.stage(full.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"), name)

    centre = indexed.groupBy("key").agg(F.min(F.struct("node_", "size_", "sketch_")).alias("c")).select("key", "c.*")
    stars = scratch.stage(keyed.join(centre, "key").where((F.col("node") != F.col("node_")) & _bound(edits)).selectExpr(*_PAIR).distinct(), "stars")
    links = confirmed(stars, "links")
    roots = scratch.stage(components(links, scratch, "a"), "roots")
    # what is left to compare: lines of one bucket that are in different components, in buckets that hold several
    placed = scratch.stage(keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("key")
    open_ = scratch.stage(placed.join(mixed, "key", "left_semi"), "open")
    more = confirmed(_across(open_, edits).distinct().join(stars, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        roots = scratch.stage(components(links.unionByName(more), scratch, "b"), "roots2")
    for name in ("lines", "stars", "placed", "open"):
        scratch.drop(name)
    return roots


def find(
    docs: DataFrame, edits: int = 2, min_chars: int = 20, near_chars: int = 40, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the input's rows with a number `__row`, staged, and (row, key, n_lines, dropped, copies_of) per row:
    the places of lines to drop, counted from 0, and the sorted keys of the rows that hold the lines they repeat."""
    import xxhash

    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    staged = scratch.stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    rows = staged.select(F.col("__row").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(2).to_pylist():
                found = [normal(line) for line in content.split("\n")] if content else []
                out.append([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) if len(x) >= min_chars else None for x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.binary()))], ["row", "key", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    lines = scratch.stage(map_batches(rows, name, f"row long, key {kind}, lines array<binary>"), "named")
    roots = _near(rows, scratch, edits, max(near_chars, min_chars))
    each = lines.select("row", "key", F.posexplode("lines").alias("at", "node")).where("node IS NOT NULL")
    each = each.join(roots, "node", "left").select("row", "key", "at", F.coalesce("root", "node").alias("node"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "at")).alias("first")
    again = scratch.stage(each.groupBy("node").agg(first, F.count("*").alias("n")).where("n > 1").select("node", "first"), "again")
    dropped = (
        each.join(again, "node").where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
        .groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("dropped"), F.sort_array(F.collect_set("first.key")).alias("copies_of"))
    )
    return staged, (
        lines.select("row", "key", F.size("lines").alias("n_lines")).join(dropped, "row", "left").select(
            "row", "key", "n_lines",
            F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.coalesce("copies_of", F.array().cast(f"array<{kind}>")).alias("copies_of"),
        )
    )


def apply(docs: DataFrame, edits: int = 2, min_chars: int = 20, near_chars: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns, the text without repeated lines. Rows all of whose lines with words are repeated go."""
    staged, found = find(docs, edits, min_chars, near_chars, key, text)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for content, drop in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                if drop:
                    gone = set(drop)
                    content = "\n".join(x for i, x in enumerate(content.split("\n")) if i not in gone)
                out.append(content)
                keep.append(not drop or bool(content.strip()))
            columns = [*batch.columns[:last]]
            columns[at] = pa.array(out, batch.column(at).type)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns], names)

    full = staged.join(found.where(F.size("dropped") > 0).select(F.col("row").alias("__row"), F.col("dropped").alias("__dropped")), "__row", "left")
    full = full.select(*[F.col(f"`{c}`") for c in docs.columns], "__dropped")
    at, last = docs.columns.index(text), len(docs.columns)
    return map_batches(full, cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
