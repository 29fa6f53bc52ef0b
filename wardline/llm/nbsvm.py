"""Quality classifier: Naive Bayes features under a support vector machine.

A text becomes the set of its n-grams: words, pairs of words, and triples of token shapes (letter case, digits,
runs of signs, a word said again), hashed into a fixed number of buckets. An indicator is scaled by the log ratio
of the bucket's share in the two classes, rows are scaled to length 1, and a linear hinge-loss model is fitted by
dual coordinate descent. Shards of the training rows are fitted apart and their weights averaged; margins become
scores by a logistic curve fitted on labelled rows that the model has not seen.

Training uses at most about `max_rows` labelled rows (default 20 000), chosen by the hash of their key and, where keys
have many rows, by that of key and text; equal texts of a key are one row. Shards are dealt by key and text. This bounds
all that reaches the driver or is sent to the workers: one row per bucket, one per calibration row, and the keys
of the sample. Scoring covers every row.

Results: null and empty texts have no n-grams, so their score follows from the bias alone. Rows with a null key or
label are not learned from; a key labelled more than once counts with its lowest label. With no labels, or one
class only, every row gets the smoothed share of class 1. Repeated rows get equal scores. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, alone, map_batches, utf8

BUCKETS = 1 << 18
SHARD_ROWS = 4096
MEMO_TOKENS = 1_000_000
_TOKENS = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+").findall
_SHAPES = {name: zlib.crc32(name.encode()) for name in ("lower", "title", "upper", "digits", "mixed", "again")}


def _token(token: bytes) -> tuple[int, int]:
    """(hash of the lower-cased token, hash of its shape)."""
    h = zlib.crc32(token.lower())
    if not (token[0] >= 0x80 or token[:1].isalnum()):
        return h, h
    letters = bytes(b for b in token if b < 0x80 and not 48 <= b <= 57)
    if not letters:
        return h, _SHAPES["digits" if token.isdigit() else "lower"]
    if letters.islower():
        return h, _SHAPES["lower"]
    if letters.isupper():
        return h, _SHAPES["upper" if len(token) > 1 else "title"]
    return h, _SHAPES["title" if letters[1:].islower() else "mixed"]


class _Memo(dict):
    def __missing__(self, token: bytes) -> tuple[int, int]:
        if len(self) >= MEMO_TOKENS:
            self.clear()
        self[token] = out = _token(token)
        return out


_MEMO = _Memo()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    tokens = _TOKENS(utf8(text))
    if not tokens:
        return np.empty(0, np.int64)
    both = np.array(list(map(_MEMO.__getitem__, tokens)), np.uint64)
    word, shape = both[:, 0], both[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] = _SHAPES["again"]
    three = np.uint64(3)
    parts = [word * three, (word[:-1] * _MIX + word[1:]) * three + np.uint64(1)]
    parts.append(((shape[:-2] * _MIX + shape[1:-1]) * _MIX + shape[2:]) * three + np.uint64(2))
    return np.unique(_spread(np.concatenate(parts), buckets))


@dataclass(frozen=True)
class Model:
    """Score of a text: 1 / (1 + exp(-(slope * margin + offset)))."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        own = self.ratios[found]
        length = float(np.sqrt(own @ own))
        return self.bias + (float(self.weights[found] @ own) / length if length else 0.0)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text, len(self.ratios))) + self.offset
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model of sparse rows, by dual coordinate descent; labels are 1 and -1. The
    cost of a row is weighed by the share of the other class."""
    values = []
    for found in rows:
        own = ratios[found]
        length = np.sqrt(own @ own)
        values.append(own / length if length else own)
    share = {s: max(1, int((labels == s).sum())) for s in (1, -1)}
    most = np.array([cost * len(labels) / (2 * share[int(s)]) for s in labels])
    squares = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(labels))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            found, own, s = rows[i], values[i], labels[i]
            gradient = s * (weights[found] @ own + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), most[i])
            if step := (new - alpha[i]) * s:
                alpha[i] = new
                weights[found] += step * own
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gs, go = ((p - target) * margins).sum() + 1e-3 * (slope - 1), (p - target).sum()
        a, b, c = (w * margins * margins).sum() + 1e-3, (w * margins).sum(), w.sum()
        det = a * c - b * b
        if det <= 0:
            break
        ds, do = (c * gs - b * go) / det, (a * go - b * gs) / det
        size = max(1.0, abs(ds) / 2, abs(do) / 2)
        slope, offset = slope - ds / size, offset - do / size
        if abs(ds) + abs(do) < 1e-9:
            break
    return float(max(slope, 1e-3)), float(offset)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label",
    max_rows: int = 20_000, buckets: int = BUCKETS, cost: float = 1.0, epochs: int = 20,
) -> Model:
    """Learn from the labelled rows (labels: key and a label of 0 or 1); a fifth of the sample sets the curve."""
    spark = docs.sparkSession
    own = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("__y"))
    total = own.count()
    if total > max_rows:
        share = F.lit(int(max_rows / total * (1 << 32)))
        own = own.where(F.pmod(F.xxhash64(key), F.lit(1 << 32)) < share)
    scratch = Scratch(spark, "nbsvm")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("nbsvm", _MEMO.clear)
        for batch in batches:
            found = [features(t, buckets).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], ["y", "found", "part"])

    # the sample's keys and labels: max_rows of these at most
    picked = docs.select(key, text).join(F.broadcast(own), key)
    n_rows = docs.select(key).join(F.broadcast(own), key).count()
    if n_rows > max_rows * 5 // 4:  # keys with many rows: as many of their distinct texts as fit the bound
        kinds = picked.select(F.xxhash64(key, text).alias("h")).distinct().count()
        if kinds > max_rows:
            least = F.lit(int(max_rows / kinds * (1 << 32)))
            picked = picked.where(F.pmod(F.xxhash64(F.lit("row"), F.col(key), F.col(text)), F.lit(1 << 32)) < least)
    picked = picked.distinct()  # equal texts of a key are one row
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(key), F.col(text)), F.lit(5 * 1009)).cast("int")
    rows = scratch.stage(map_batches(picked.select(F.col("__y").cast("int").alias("y"), text, part.alias("part")), cut, "y int, found array<int>, part int"), "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for y, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[y, found.values.to_numpy()] += 1
                n[y] += 1
        at = np.flatnonzero(sums.any(axis=0))
        columns = [np.append(at, -1), np.append(sums[0, at], n[0]), np.append(sums[1, at], n[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "n0", "n1"])

    fitted, curve = F.col("part") % 5 != 0, F.col("part") % 5 == 0
    # one row per bucket at most
    counts = (
        rows.where(fitted).select("y", "found").mapInArrow(count, "bucket long, n0 long, n1 long")
        .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    )
    inside = counts[counts.bucket >= 0]
    n0, n1 = (int(counts.loc[counts.bucket < 0, c].sum()) for c in ("n0", "n1"))
    if not n0 or not n1:
        all_n1, all_n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
        p = (all_n1 + 1) / (all_n + 2)
        scratch.drop("rows")
        return Model(np.zeros(buckets), np.zeros(buckets), 0.0, 1.0, float(np.log(p / (1 - p))))
    sums = np.ones((2, buckets))
    sums[0, inside.bucket] += inside.n0
    sums[1, inside.bucket] += inside.n1
    ratios = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    sent = spark.sparkContext.broadcast(ratios)
    shards = -(-(n0 + n1) // SHARD_ROWS)

    def train(table: pa.Table) -> pa.Table:
        found = [r.values.to_numpy() for r in table.column("found").combine_chunks()]
        y = np.array(table.column("y").to_pylist())
        order = np.lexsort((y, [zlib.crc32(f.tobytes()) for f in found]))
        weights, bias = descend([found[i] for i in order], np.where(y[order] == 1, 1.0, -1.0), sent.value, cost, epochs)
        at = np.flatnonzero(weights)
        return pa.table({"bucket": np.append(at, -1), "w": np.append(weights[at], bias) * len(y)})

    learned = (
        rows.where(fitted).withColumn("shard", (F.col("part") / 5).cast("int") % shards)
        .groupBy("shard").applyInArrow(train, "bucket long, w double")
        .groupBy("bucket").agg(F.sum("w").alias("w")).toPandas()
    )
    weights = np.zeros(buckets)
    own_w = learned[learned.bucket >= 0]
    weights[own_w.bucket] = own_w.w / (n0 + n1)
    model = Model(ratios, weights, float(learned.loc[learned.bucket < 0, "w"].sum() / (n0 + n1)), 1.0, 0.0)
    told = spark.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [told.value.margin(f.values.to_numpy()) for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.float64())], ["y", "m"])

    seen = rows.where(curve).select("y", "found").mapInArrow(margins, "y int, m double").orderBy("m", "y").toPandas()
    scratch.drop("rows")
    slope, offset = logistic(seen.m.to_numpy(float), seen.y.to_numpy())
    return Model(ratios, weights, model.bias, slope, offset)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, score) of every row; with `keep`, all columns of the input and `score`."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep else [key]
    at = len(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("nbsvm", _MEMO.clear)
        for batch in batches:
            found = pa.array([told.value.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], found], [*columns, "score"])

    taken = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:at]) + ", score double"
    return map_batches(taken, work, schema)
