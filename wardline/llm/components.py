"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch


def _star(both: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): the neighbours of u that are larger (large) or smaller (small) move to the least."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached. Each round's edges
    are written to the shared folder, so that lost executors cost one round at most; rounds grow with the logarithm
    of the longest path."""
    now = edges.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    now = scratch.stage(now.distinct(), f"{name}0")
    sign = None
    for k in range(1, 60):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = scratch.stage(_star(both, True).where("u != v").distinct(), f"{name}{k}l")
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new = scratch.stage(_star(down, False).where("u != v").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k}l")
        found = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}{k - 1}")
        now = new
        if found == sign:
            break
        sign = found
    else:
        raise RuntimeError("the components are not stable after 59 rounds")
    scratch.drop(f"{name}0")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
