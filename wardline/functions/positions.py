"""Positions in groups of any size, by a range sort and the sizes of its partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.keys import same_keys
from wardline.sources.staging import stage


def with_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the place of a row in its group, from 0; nulls come first.

    Rows are dealt by ranges of group and order, so a group that holds most of
    them, or one time of day of it, is many partitions of like size. A place is
    the row's place in its partition, and before that the rows that its group
    has in earlier partitions: one small row per group and partition, added up
    along each group. The sorted rows are written once, as both the sizes and
    the places come from them, so calling this runs a job.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    shifts = parts.select(*group, "_part", (before - F.col("_first")).alias("_shift"))
    joined = placed.alias("l").join(shifts.alias("r"), same_keys("l", "r", [*group, "_part"]))
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))
