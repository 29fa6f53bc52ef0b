"""Benchmark passages in documents, by a prefix-filtered set join.

Words are runs of letters and digits; an item's windows are its runs of 10 words, or the whole item where it is
shorter. A window is the set of its shingles (5 words, or all of it where it is shorter), and a document has the
window if it contains the whole set in place, a containment of 1. For that threshold one prefix token suffices: the
window's rarest shingle by its count over all documents. Documents and windows meet on it; the window's length and
the shingle's place in it bound where the window must lie, and its words are then compared one by one.

One pass over the texts keeps only the word runs made of shingles that occur in some item, by a bit table of fixed
size (8 MB, whatever the size of the benchmark: a full table only filters less). All the rest works on those
runs, so that the texts are read once and are never shuffled.

Results: one row per row of the documents, rows with equal keys included. Null and empty texts have no words and no
hits. Null and empty items have no windows; an item whose id is null marks words but is not listed. No documents
give no rows, no items give rows without hits. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, WordHashes, alnum_words, alone, map_batches, row_numbers, shingle_hashes

TABLE_BITS = 26
_HASHES = WordHashes()


def item_windows(items: DataFrame, window: int, shingle: int, item: str, text: str) -> DataFrame:
    """(item_id, words, size, shingles array<struct<at, words>>, bits array<long>) per window of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(data)
                size = min(window, len(words))
                for at in range(len(words) - size + 1 if size else 0):
                    own = words[at:at + size]
                    k = min(shingle, size)
                    rows[0].append(key)
                    rows[1].append(b" ".join(own).decode("utf-8", "replace"))
                    rows[2].append(size)
                    rows[3].append([{"at": p, "words": b" ".join(own[p:p + k]).decode("utf-8", "replace")} for p in range(size - k + 1)])
                    rows[4].append((shingle_hashes(_HASHES.of(own), k) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
            kinds = [batch.column(0).type, pa.string(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("words", pa.string())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["item_id", "words", "size", "shingles", "bits"])

    kind = items.schema[item].dataType.simpleString()
    own = items.select(F.col(item).alias("item_id"), F.col(text).cast("binary").alias("data"))
    return map_batches(own, work, f"item_id {kind}, words string, size int, shingles array<struct<at: int, words: string>>, bits array<long>")


def _bit_table(windows: DataFrame) -> np.ndarray:
    """The bit table of all shingles: 2**26 bits, one row per 64 of them on the way to the driver."""
    bit = F.explode("bits").alias("bit")
    found = (
        windows.select(bit).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("mask")).toPandas()
    )
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[found.word.to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return table


def _runs(docs: DataFrame, table: np.ndarray, sizes: list[int], least: int, key: str, text: str) -> DataFrame:
    """(row, key, n_words, runs array<array<string>> with their starts) per document."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("decontaminate", _HASHES.clear)
        bits, first, part = sent.value, 0, TaskContext.get().partitionId()
        for batch in batches:
            counts, runs = [], []
            for data in batch.column(1).to_pylist():
                words = alnum_words(data)
                counts.append(len(words))
                hashes, steps = _HASHES.of(words), np.zeros(len(words) + 1, np.int32)
                for size in sizes:
                    at = shingle_hashes(hashes, size) >> np.uint64(64 - TABLE_BITS)
                    hit = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                    np.add.at(steps, hit, 1)
                    np.add.at(steps, hit + size, -1)
                covered = np.concatenate(([0], (np.cumsum(steps)[:-1] > 0).astype(np.int8), [0]))
                edges = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
                runs.append([
                    {"start": int(a), "words": [w.decode("utf-8", "replace") for w in words[a:b]]}
                    for a, b in edges if b - a >= least
                ])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string()))]))
            rows = row_numbers(first, len(counts), part)
            first += len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind)], ["row", "key", "n_words", "runs"]
            )

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("data"))
    return map_batches(own, work, f"row long, key {kind}, n_words long, runs array<struct<start: int, words: array<string>>>")


def find(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (row, key, n_words) per document, and (row, start, size, words) per place of a window in one, where
    `start` counts words from 0; the second also has `items`, the sorted ids of the items that hold the window."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    every = scratch.stage(item_windows(items, window, shingle, item, item_text), "windows")
    windows = every.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    sizes = [r.size for r in every.select(F.array_size("bits").alias("n"), "size").groupBy("size").count().select("size").collect()]  # window at most
    needed = sorted({min(shingle, s) for s in sizes})
    passed = scratch.stage(_runs(docs, _bit_table(every), needed, min(sizes, default=1), key, text), "runs")
    run = passed.select("row", F.explode("runs").alias("run")).select("row", "run.start", "run.words")
    # each shingle of a run with the words around it that a window can reach
    around = None
    for size in needed:
        reach = window - size
        places = F.transform(
            F.sequence(F.lit(0), F.size("words") - size),
            lambda p: F.struct(
                p.alias("at"),
                F.array_join(F.slice("words", p + 1, size), " ").alias("shingle"),
                F.greatest(p - reach, F.lit(0)).alias("from"),
                F.slice("words", F.greatest(p - reach, F.lit(0)) + 1, 2 * window - size).alias("near"),
            ),
        )
        own = run.where(F.size("words") >= size).select("row", "start", F.explode(places).alias("p")).select(
            "row", (F.col("start") + F.col("p.from")).alias("base"), (F.col("p.at") - F.col("p.from")).alias("at"), "p.shingle", "p.near"
        )
        around = own if around is None else around.unionByName(own)
    if around is None:
        empty = "row long, start int, size int, words string, items array<string>"
        return passed.select("row", "key", "n_words"), docs.sparkSession.createDataFrame([], empty)
    counts = around.groupBy("shingle").agg(F.count("*").alias("n"))
    # the rarest shingle of each window all of whose shingles occur
    parts = windows.select("words", "size", F.size("shingles").alias("k"), F.explode("shingles").alias("s"))
    rarest = (
        parts.join(counts, F.col("s.words") == F.col("shingle"))
        .groupBy("words", "size", "k")
        .agg(F.count("*").alias("known"), F.min(F.struct("n", "shingle", "s.at")).alias("least"))
        .where("known = k").select("words", "size", F.col("least.shingle").alias("shingle"), F.col("least.at").alias("place"))
    )
    prefix = scratch.stage(rarest, "prefix")
    begin = F.col("at") - F.col("place")
    hits = (
        around.join(prefix, "shingle")
        .where((begin >= 0) & (begin + F.col("size") <= F.size("near")))
        .where(F.array_join(F.slice("near", begin + 1, F.col("size")), " ") == F.col("words"))
        .select("row", (F.col("base") + begin).alias("start"), "size", "words")
    )
    # shingles of several sizes may find a window at one place
    owners = every.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return passed.select("row", "key", "n_words"), hits.distinct().join(owners, "words", "left")


def report(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, items) per document: words inside windows, and the sorted ids of items found."""
    passed, hits = find(docs, items, window, key=key, text=text, item=item, item_text=item_text)
    places = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        places.withColumn("before", F.coalesce(before, F.lit(0)))
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    )
    found = (
        hits.select("row", "words", "items").dropDuplicates(["row", "words"]).select("row", F.explode("items").alias("item"))
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        passed.join(covered, "row", "left").join(found, "row", "left")
        .select(
            F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def apply(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The input's columns, without the rows that hold a window of an item."""
    scratch = Scratch(docs.sparkSession, "clean-rows")
    staged = scratch.stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = report(staged.select("__row", F.col(text).alias("__text")), items, window, "__row", "__text", item, item_text)
    gone = found.where("n_hit > 0").select("__row")
    return staged.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
