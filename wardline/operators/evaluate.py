"""Scoring of findings against labels, and summaries of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import severity as sev


def mark_detected(labelled: DataFrame, findings: DataFrame, name: str = "name") -> DataFrame:
    """Add ``detected``: whether any finding, suppressed or not, carries the row's name.

    Detection goes by name, so rows that share a name share the answer. The
    findings are reduced to distinct names before the join.
    """
    names = findings.select(F.col("tool_name").alias(name)).distinct().withColumn("_hit", F.lit(True))
    return labelled.join(names, name, "left").select(
        *labelled.columns, F.coalesce("_hit", F.lit(False)).alias("detected")
    )


def confusion(labelled: DataFrame, findings: DataFrame, name: str = "name", label: str = "is_attack") -> DataFrame:
    """One row: tools_total, tp, fp, fn, tn."""
    attack = F.coalesce(F.col(label), F.lit(False))
    hit = F.col("detected")
    return mark_detected(labelled, findings, name).agg(
        F.count("*").alias("tools_total"),
        F.count_if(attack & hit).alias("tp"),
        F.count_if(~attack & hit).alias("fp"),
        F.count_if(attack & ~hit).alias("fn"),
        F.count_if(~attack & ~hit).alias("tn"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1; each is 0.0 where its denominator is 0."""
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", _ratio(2 * p * r, p + r))
    )


def benchmark_report(labelled: DataFrame, findings: DataFrame, **names) -> DataFrame:
    return precision_recall_f1(confusion(labelled, findings, **names))


def detection_rate(labelled: DataFrame, findings: DataFrame, group: Column, name: str = "name") -> DataFrame:
    """group, total, detected, percent. Rows with the same name count one by one."""
    rows = mark_detected(labelled, findings, name)
    return rows.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if("detected").alias("detected")
    ).withColumn("percent", F.col("detected") * 100 / F.col("total"))


def rate_by_paradigm(labelled: DataFrame, findings: DataFrame, paradigm: str = "paradigm", **names) -> DataFrame:
    return detection_rate(labelled, findings, F.col(paradigm).alias("paradigm"), **names)


def rate_by_risk(labelled: DataFrame, findings: DataFrame, risk: str = "risk_category", **names) -> DataFrame:
    """By risk category, missing as 'Unknown', largest first."""
    group = F.coalesce(F.col(risk), F.lit("Unknown")).alias("risk_category")
    return detection_rate(labelled, findings, group, **names).orderBy(F.desc("total"), "risk_category")


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def scan_totals(findings: DataFrame, tools: DataFrame) -> DataFrame:
    """One row: active, suppressed, tools_scanned."""
    kinds = findings.select(F.when(F.col("suppressed"), "suppressed").otherwise("active").alias("kind")).unionByName(
        tools.select(F.lit("tool").alias("kind"))
    )
    return kinds.agg(
        F.count_if(F.col("kind") == "active").alias("active"),
        F.count_if(F.col("kind") == "suppressed").alias("suppressed"),
        F.count_if(F.col("kind") == "tool").alias("tools_scanned"),
    )


def false_positive_rate(labelled: DataFrame, findings: DataFrame, name: str = "name", label: str = "is_attack"):
    """One row: clean_total, flagged, rate over the rows that are not attacks."""
    clean = labelled.where(~F.coalesce(F.col(label), F.lit(False)))
    return mark_detected(clean, findings, name).agg(
        F.count("*").alias("clean_total"), F.count_if("detected").alias("flagged")
    ).withColumn("rate", _ratio(F.col("flagged"), F.col("clean_total")))


def per_server_counts(servers: DataFrame, findings: DataFrame, server: str = "server") -> DataFrame:
    """server, findings: zero for servers without any, in name order."""
    counts = findings.groupBy(server).agg(F.count("*").alias("_n"))
    return (
        servers.select(server).distinct().join(counts, server, "left")
        .select(server, F.coalesce("_n", F.lit(0)).alias("findings"))
        .orderBy(server)
    )


def gate(findings: DataFrame, minimum: str = "high") -> DataFrame:
    """One row: blocking, true if an active finding is at least ``minimum``."""
    hit = ~F.col("suppressed") & (F.col("severity_rank") >= sev.rank(F.lit(minimum)))
    return findings.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("blocking"))


def regression_gate(report: DataFrame, min_recall: float = 1.0, min_precision: float = 0.90) -> DataFrame:
    """Add ``passed``."""
    return report.withColumn(
        "passed", (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)
    )
