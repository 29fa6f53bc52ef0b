"""Similarity of texts to labelled archetype texts (TF-IDF, cosine).

``fit`` and ``score`` work on tables of any size. The six built-in archetypes
have 73 terms, so for them ``default_model`` turns the fitted tables into
constants and the scan scores each text inside its own row, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import ascii_lower, terms
from wardline.rules import archetypes as A
from wardline.sources.staging import stage

#: Weights, or signs of terms or labels, that a worker may hold.
HELD_WEIGHTS = 4_000_000


def archetype_table(spark: SparkSession) -> DataFrame:
    rows = [(i, label, text, signal, refs.split()) for i, (label, text, signal, refs) in enumerate(A.ARCHETYPES, 1)]
    return spark.createDataFrame(
        rows, "position int, label string, text string, signal string, corpus_refs array<string>"
    )


def fit(archetypes: DataFrame, position: str = "position", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(idf, weights)``: term, idf = ln(N/df)+1; and position, term, weight with unit length per archetype."""
    tokens = archetypes.select(
        F.col(position).alias("position"), F.explode(terms(ascii_lower(F.col(text)))).alias("term")
    )
    tf = tokens.groupBy("position", "term").agg(F.count("*").alias("n"))
    size = archetypes.select(F.count_distinct(position)).scalar()
    idf = (
        tf.groupBy("term").agg(F.count("*").alias("df"))
        .select("term", (F.log(size / F.col("df")) + 1).alias("idf"))
    )
    raw = tf.join(idf, "term").select("position", "term", (F.col("n") * F.col("idf")).alias("raw"))
    norms = raw.groupBy("position").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    weights = raw.join(norms, "position").select("position", "term", (F.col("raw") / F.col("norm")).alias("weight"))
    return idf, weights


def score(
    texts: DataFrame,
    archetypes: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_cosine: float = A.MIN_COSINE,
    min_terms: int = A.MIN_SHARED_TERMS,
    most: int = HELD_WEIGHTS,
) -> DataFrame:
    """key, label, signal, cosine, corpus_refs: the first archetype in order per signal that is near enough.

    The fitted weights are a sparse matrix by term. Up to ``most`` weights (about
    16 bytes each) and as many signs of terms and labels go to the workers; each
    text is then read once, its terms are counted, and the rows of the matrix
    that they name are added up, so no term is shuffled and no row meets another.
    Beyond that the terms are joined (``score_by_join``), with the same rows.
    Rows of a repeated key are scored one by one.
    """
    idf, weights = fit(archetypes)
    spark = texts.sparkSession
    size = weights.agg(F.count("*"), F.sum(F.length("term"))).first()
    told = archetypes.select(F.count("*"), F.sum(F.length(F.concat_ws(" ", "label", "signal", F.concat_ws(" ", "corpus_refs"))))).first()
    if max(size[0], size[1] or 0, told[0], told[1] or 0) > most:
        return score_by_join(texts, archetypes, key, text, min_cosine, min_terms)
    terms_ = idf.orderBy("term").toArrow()
    number = {t: k for k, t in enumerate(terms_.column(0).to_pylist())}
    factors = terms_.column(1).to_numpy()
    listed = archetypes.select("position", "label", "signal", "corpus_refs").orderBy("position").collect()
    place = {r.position: k for k, r in enumerate(listed)}
    table = weights.select("position", "term", "weight").toArrow()
    rows = np.fromiter((number[t] for t in table.column(1).to_pylist()), np.int64, table.num_rows)
    order = np.argsort(rows, kind="stable")
    starts = np.searchsorted(rows[order], np.arange(len(number) + 1))
    columns = np.fromiter((place[p] for p in table.column(0).to_pylist()), np.int64, table.num_rows)[order]
    values = table.column(2).to_numpy()[order]
    told_of = [(r.label, r.signal, list(r.corpus_refs or [])) for r in listed]
    found = _near(number, factors, starts, columns, values, told_of, min_cosine, min_terms)(F.col(text))
    near = texts.where(F.col(text).isNotNull()).select(key, F.explode(found).alias("b"))
    return near.select(key, "b.label", "b.signal", "b.cosine", "b.corpus_refs")


def _near(number: dict, factors, starts, columns, values, told: list, min_cosine: float, min_terms: int):
    """Column function: the archetypes near a text, the first in order per signal."""
    signs = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 0x20 for b in range(256))

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def near(text: str) -> list[dict]:
            counts = Counter(text.encode().translate(signs).decode().split())
            held = sorted((k, n) for t, n in counts.items() if (k := number.get(t)) is not None)
            if len(held) < min_terms:
                return []
            ids, n = np.array(held, np.int64).T
            raw = n * factors[ids]
            sizes = starts[ids + 1] - starts[ids]
            at = np.repeat(starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            met, inverse = np.unique(columns[at], return_inverse=True)
            cosines = np.bincount(inverse, np.repeat(raw, sizes) * values[at], len(met)) / np.sqrt((raw * raw).sum())
            first: dict[str, dict] = {}
            for k in np.flatnonzero(cosines >= min_cosine):
                label, signal, refs = told[met[k]]
                first.setdefault(signal, {"label": label, "signal": signal, "cosine": float(cosines[k]), "corpus_refs": refs})
            return list(first.values())

        for batch in batches:
            yield batch.map(near)

    return F.pandas_udf(search, "array<struct<label:string,signal:string,cosine:double,corpus_refs:array<string>>>")


def score_by_join(
    texts: DataFrame,
    archetypes: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_cosine: float = A.MIN_COSINE,
    min_terms: int = A.MIN_SHARED_TERMS,
) -> DataFrame:
    """The rows of ``score`` for vocabularies that no worker can hold: terms are joined, their counts added up first.

    The texts' terms are staged, as norms and products both need them, so calling this runs a job.
    """
    idf, weights = fit(archetypes)
    counted = (
        texts.where(F.col(text).isNotNull())
        .select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
        .select("_row", "_key", F.explode(terms(ascii_lower(F.col("_text")))).alias("term"))
        .groupBy("_row", "_key", "term").agg(F.count("*").alias("n"))
    )
    tf = stage(counted.join(idf, "term").select("_row", "_key", "term", (F.col("n") * F.col("idf")).alias("raw")))
    norms = (
        tf.groupBy("_row", "_key")
        .agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.count("*").alias("shared"))
        .where(F.col("shared") >= min_terms)
    )
    dots = tf.join(weights, "term").groupBy("_row", "position").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    near = (
        dots.join(norms, "_row")
        .select("_row", "_key", "position", (F.col("dot") / F.col("norm")).alias("cosine"))
        .where(F.col("cosine") >= min_cosine)
        .join(archetypes.select("position", "label", "signal", "corpus_refs"), "position")
    )
    best = near.groupBy("_row", "_key", "signal").agg(
        F.min_by(F.struct("label", "cosine", "corpus_refs"), "position").alias("b")
    )
    return best.select(F.col("_key").alias(key), "b.label", "signal", "b.cosine", "b.corpus_refs")


@dataclass(frozen=True)
class Model:
    """The fitted built-in archetypes as constants."""

    idf: dict  # term -> idf
    weights: list  # per archetype: term -> weight


@cache
def default_model() -> Model:
    """Fit of the six built-in archetypes; a few dozen numbers, needed to write the plan."""
    split = [text.split() for _, text, _, _ in A.ARCHETYPES]
    vocabulary = {t for terms_ in split for t in terms_}
    idf = {t: math.log(len(split) / sum(t in s for s in split)) + 1 for t in sorted(vocabulary)}
    weights = []
    for tokens in split:
        raw = {t: tokens.count(t) * idf[t] for t in tokens}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        weights.append({t: v / norm for t, v in raw.items()})
    return Model(idf, weights)
