"""Accepted findings: a table of (tool, signal, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_suppressions(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Set ``suppressed`` on findings whose (tool, signal) is listed; earlier marks stay.

    The list is made distinct and joined without a hint: Spark broadcasts it
    while it is small and shuffles both sides when it is not.
    """
    listed = entries.select(F.col("tool").alias("tool_name"), "signal").distinct().withColumn("_listed", F.lit(True))
    marked = findings.join(listed, ["tool_name", "signal"], "left")
    return marked.withColumn(
        "suppressed", F.col("suppressed") | F.coalesce("_listed", F.lit(False))
    ).select(*findings.columns)


def stale_suppressions(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries that no finding matches any more."""
    seen = findings.select(F.col("tool_name").alias("tool"), "signal").distinct()
    return entries.join(seen, ["tool", "signal"], "left_anti").select(*entries.columns)


def add_suppressions(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(all entries, rejected)``: new entries whose (tool, signal) is taken are rejected."""
    taken = entries.select("tool", "signal").distinct()
    fresh = new.join(taken, ["tool", "signal"], "left_anti").select(*entries.columns)
    rejected = new.join(taken, ["tool", "signal"], "left_semi").select(*entries.columns)
    return entries.unionByName(fresh), rejected
