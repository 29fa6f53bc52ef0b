"""Severity ladder, SARIF levels and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.constants import lookup
from wardline.rules import signals as S


def rank(severity: Column) -> Column:
    """info 0 ... critical 4; null for anything else."""
    return lookup({name: i for i, name in enumerate(S.SEVERITIES)}, severity, "int")


def sarif_level(severity: Column) -> Column:
    return lookup(S.SARIF_LEVELS, severity)


def score(scope: Column, confidentiality: Column, integrity: Column) -> Column:
    return (
        lookup(S.SCOPE_POINTS, scope, "int")
        + lookup(S.IMPACT_POINTS, confidentiality, "int")
        + lookup(S.IMPACT_POINTS, integrity, "int")
    )


def score_severity(points: Column) -> Column:
    """Severity of an additive score."""
    out = F
    for name, floor in S.SCORE_FLOORS:
        out = out.when(points >= floor, name)
    return out.when(points > 0, "low").otherwise("info")


def rules_table(spark: SparkSession, prefix: str = "WARD") -> DataFrame:
    """The 28 rules: signal, rule_id, description, tags."""
    rows = [(n, S.rule_id(n, prefix), d, t.split()) for n, t, d in S.SIGNALS]
    return spark.createDataFrame(rows, "signal string, rule_id string, description string, tags array<string>")


def rule_lookup(df: DataFrame, prefix: str = "WARD") -> DataFrame:
    """Add rule_id, description and tags by signal. The rule table has 28 rows, so it is broadcast."""
    return df.join(F.broadcast(rules_table(df.sparkSession, prefix)), "signal", "left")


def rule_id(signal: Column, prefix: str = "WARD") -> Column:
    return lookup({n: S.rule_id(n, prefix) for n in S.SIGNAL_NAMES}, signal)
