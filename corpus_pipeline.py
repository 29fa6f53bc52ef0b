"""Cleaning a corpus of documents, stage by stage, down to token ids.

Each stage takes what the one before has kept and returns the columns of `documents`; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontaminate, line_dedup, nbsvm, near_dedup
from wardline.llm.common import Scratch, hashed_out

#: Documents that score less go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the documents it gets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(hashed_out("doc_id", 5) != 0)
    model = nbsvm.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return nbsvm.score(docs, model, keep=True).where(F.col("score") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; those with no other lines go."""
    out = line_dedup.apply(docs, near_chars=20)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.apply(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) per document; ids are little-endian unsigned 32-bit integers."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("clean", clean), ("tokens", tokens)]

#: SQL can express neither the classifier nor the joins on edits and shingles; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.stage(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
