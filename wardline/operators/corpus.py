"""Labelled attack records: checks, filters, additions, and a scan of their own payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.findings import finding
from wardline.operators.scan import scan_text
from wardline.operators.sequence import EVIDENCE, sequence_severity
from wardline.rules import records as R
from wardline.rules import signals as S

RECORD_SCHEMA = (
    "id string, version string, category string, subcategory string, paradigm smallint, vector string, "
    "payload string, injection_point string, trigger_condition string, expected_behavior string, "
    "detection_signals array<string>, severity string, source string, source_url string, cve string, "
    "tags array<string>"
)


def record_errors() -> Column:
    """Array of error texts of an attack record row; empty if it is valid."""
    missing = [
        F.when(F.col(c).isNull(), f"missing {c}") for c in [*R.REQUIRED_STRINGS, *R.REQUIRED_ARRAYS]
    ]
    unknown = [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), F.concat(F.lit(f"unknown {c} "), F.col(c)))
        for c, allowed in (("category", R.CATEGORIES), ("vector", R.VECTORS), ("severity", S.SEVERITIES))
    ]
    return F.array_compact(F.array(*missing, *unknown))


def validate_records(records: DataFrame) -> DataFrame:
    """Add ``errors`` and ``valid``."""
    return records.withColumn("errors", record_errors()).withColumn("valid", F.size("errors") == 0)


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: bad rows keep their errors. A column ``type_errors`` counts with the errors."""
    checked = validate_records(records)
    if "type_errors" in records.columns:
        errors = F.concat("type_errors", "errors")
        checked = checked.withColumns({"errors": errors, "valid": F.size(errors) == 0}).drop("type_errors")
    return checked.where("valid").drop("errors", "valid"), checked.where("NOT valid").drop("valid")


def filter_category(records: DataFrame, category: str) -> DataFrame:
    if category not in R.CATEGORIES:
        raise ValueError(f"unknown category {category!r}; expected one of {', '.join(R.CATEGORIES)}")
    return records.where(F.col("category") == category)


def filter_min_severity(records: DataFrame, severity: str) -> DataFrame:
    if severity not in S.SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}; expected one of {', '.join(S.SEVERITIES)}")
    return records.where(F.col("severity").isin(S.SEVERITIES[S.SEVERITIES.index(severity):]))


def corpus_list(records: DataFrame, category: str | None = None, severity: str | None = None) -> DataFrame:
    """id, category, severity, paradigm ('-' if none), subcategory of the selected records."""
    if category is not None:
        records = filter_category(records, category)
    if severity is not None:
        records = filter_min_severity(records, severity)
    return records.select(
        "id", "category", "severity", F.coalesce(F.col("paradigm").cast("string"), F.lit("-")).alias("paradigm"),
        "subcategory",
    )


def add_records(records: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed by id; a new record replaces the old one. A partial aggregate by id, not a window."""
    both = records.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [c for c in records.columns if c != "id"]
    latest = both.groupBy("id").agg(F.max_by(F.struct(*rest), "_age").alias("_r"))
    return latest.select("id", "_r.*").select(*records.columns)


def extend_corpus(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base and extra records together; duplicates stay."""
    return base.unionByName(extra)


def peer_name(record_id: Column) -> Column:
    return F.concat(F.lit("peer_"), F.translate(F.lower(record_id), "-.", "__"))


def corpus_selfscan(
    records: DataFrame, record_id: str = "id", payload: str = "payload", paradigm: str = "paradigm",
    keep: Sequence[str] = (), **options,
) -> DataFrame:
    """Scan payloads of records with a paradigm as descriptions of a peer tool.

    Each record also gives one unexpected_tool_sequence row, since its only
    call has an empty baseline. Details start with the record id.
    """
    rows = records.where(F.col(paradigm).isNotNull()).select(
        *keep, F.col(record_id).alias("_id"), peer_name(F.col(record_id)).alias("_peer"),
        F.coalesce(F.col(payload), F.lit("")).alias("_payload"),
    )
    signal = "unexpected_tool_sequence"
    call = finding(
        "sequence", signal, sequence_severity(F.lit(signal)),
        F.replace(F.lit(EVIDENCE[signal]), F.lit("%s"), F.col("_peer")),
        F.concat(F.lit("chain step 1: "), F.col("_peer"), F.lit("()")), (),
    )
    found = scan_text(rows, text="_payload", name="_peer", keep=[*keep, "_id"], extra=F.array(call), **options)
    prefixed = F.concat(F.lit("[peer-inject: "), F.col("_id"), F.lit("] "), F.col("detail"))
    return found.withColumn("detail", prefixed).drop("_id")
