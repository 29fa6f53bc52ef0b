"""Definitions that changed, or appeared, between two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import severity as sev
from wardline.functions.jsontext import json_key
from wardline.functions.keys import same_keys

EVIDENCE = "definition differs between two listings"
DETAIL = "The definition changed, or first appeared, between two listings of one session"


def definition_hash(name: str, description: str, schema: str, annotations: str) -> Column:
    """64-bit hash of a definition; key order inside the JSON columns does not matter.

    JSON that cannot be read counts as it stands.
    """
    parts = [F.col(name), F.col(description), json_key(F.col(schema)), json_key(F.col(annotations))]
    present = F.concat(*[F.when(p.isNull(), "0").otherwise("1") for p in parts])  # null is not ''
    return F.xxhash64(*parts, present)


def definition_drift(
    base: DataFrame,
    fresh: DataFrame,
    group: Sequence[str] = (),
    name: str = "name",
    description: str = "description",
    schema: str = "inputSchema",
    annotations: str = "annotations",
    order: str | None = None,
) -> DataFrame:
    """Findings for names whose definition differs from the base listing or is not in it.

    ``group`` names the columns that separate listings (a server, a session).
    A group without any base row gives nothing. If the base repeats a name, the
    row with the highest ``order`` counts (which should tell them apart); without
    ``order`` a definition that equals any of them is no drift. Only hashes are shuffled. The join
    is on group, name and hash, so a group holding most rows still spreads,
    and the list of groups that have a base is reduced before it is joined.
    """
    keys = [*group, "name"]
    hashed = lambda df, *more: df.select(
        *group, F.col(name).alias("name"), definition_hash(name, description, schema, annotations).alias("h"), *more
    )
    if order:
        old = hashed(base, F.col(order).alias("_version")).groupBy(*keys).agg(F.max_by("h", "_version").alias("h"))
    else:
        old = hashed(base).distinct()
    changed = hashed(fresh).join(old, [*keys, "h"], "left_anti")
    if group:
        listed = base.select(*group).distinct()
        changed = changed.join(listed, list(group), "left_semi")
    else:
        changed = changed.where(base.select(F.lit(1)).limit(1).exists())
    return change_findings(changed, group)


def change_findings(changed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Findings of changed definitions (name), with the columns ``keep``."""
    return changed.select(
        *keep,
        F.col("name").alias("tool_name"),
        F.lit("conditional_activation").alias("signal"),
        sev.rule_id(F.lit("conditional_activation")).alias("rule_id"),
        F.lit("critical").alias("severity"),
        F.lit(4).alias("severity_rank"),
        F.lit("drift").alias("pass"),
        F.lit(None).cast("string").alias("path"),
        F.lit(EVIDENCE).alias("matched_text"),
        F.lit(DETAIL).alias("detail"),
        F.array().cast("array<string>").alias("corpus_refs"),
        F.lit(False).alias("suppressed"),
    )


def definition_changes(
    listings: DataFrame,
    base: DataFrame | None = None,
    group: Sequence[str] = ("server",),
    name: str = "name",
    description: str = "description",
    schema: str = "inputSchema",
    annotations: str = "annotations",
    at: str = "ts",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Each change of a definition along all its listings: findings with group and ``at``.

    Every version is compared with the one before it, in the order of ``at``,
    so a definition that changes and changes back is found twice; of versions
    of one time, the order of their hashes counts. The first version of a name
    is compared with the ``base`` table of first listings (its latest row, if
    it repeats a name). A name that is not in the base is a finding if its
    group has a base; else its first version sets the base.

    Only hashes are shuffled. Versions are walked by (group, name, time
    bucket), and each bucket starts from the last version of the one before,
    so a name that is listed all the time is not one task.
    """
    keys = [*group, "name"]
    hashed = lambda df: df.select(
        *group, F.col(name).alias("name"), definition_hash(name, description, schema, annotations).alias("h"), F.col(at).alias(at))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    bucket = F.coalesce(F.floor(micros / (bucket_seconds * 1_000_000)), F.lit(-(1 << 62)))
    fresh = hashed(listings).withColumns({"_bucket": bucket, "_base": F.lit(False)})
    if base is not None:
        first = hashed(base).groupBy(*keys).agg(F.max_by(F.struct("h", at), F.struct(at, "h")).alias("v"))
        fresh = fresh.unionByName(first.select(
            *keys, "v.h", F.col(f"v.{at}").alias(at), F.lit(-(1 << 63)).cast("long").alias("_bucket"), F.lit(True).alias("_base")))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(F.col(at).asc_nulls_first(), "h")
    walked = fresh.withColumn("_before", F.lag("h").over(in_bucket))
    ends = fresh.groupBy(*keys, "_bucket").agg(F.max_by("h", F.struct(at, "h")).alias("_last"))
    ends = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")))
    same = same_keys("l", "r", [*keys, "_bucket"])
    walked = walked.alias("l").join(ends.alias("r"), same).select("l.*", F.coalesce("_before", "_carried").alias("_old"))
    rows = walked.where(~F.col("_base"))
    is_new = F.lit(False)
    if base is not None:
        groups = base.select(*group).distinct().withColumn("_known", F.lit(True))
        on = same_keys("l", "g", group) if group else F.lit(True)
        rows = rows.alias("l").join(groups.alias("g"), on, "left").select("l.*", "g._known")
        is_new = F.col("_old").isNull() & F.coalesce("_known", F.lit(False))
    return change_findings(rows.where(is_new | (F.col("h") != F.col("_old"))), [*group, at])
