"""Shape of a finding, and helpers to build findings inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import severity as sev
from wardline.functions.constants import strings

# One finding inside a row, before it is exploded into the findings table.
FINDING_TYPE = (
    "struct<pass:string,signal:string,severity:string,matched_text:string,detail:string,corpus_refs:array<string>>"
)
FINDING_COLUMNS = [
    "tool_name", "signal", "rule_id", "severity", "severity_rank", "pass", "path", "matched_text", "detail",
    "corpus_refs", "suppressed",
]


def finding(pass_: str, signal: Column | str, severity: Column | str, matched: Column, detail: Column | str, refs):
    """One finding struct; ``refs`` is a list of strings or an array column."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    refs = refs if isinstance(refs, Column) else strings(refs)
    return F.struct(
        F.lit(pass_).alias("pass"),
        as_col(signal).alias("signal"),
        as_col(severity).alias("severity"),
        matched.alias("matched_text"),
        as_col(detail).alias("detail"),
        refs.cast("array<string>").alias("corpus_refs"),
    )


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING_TYPE}>")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def finding_columns(f: str = "f", rule_prefix: str = "WARD") -> list[Column]:
    """Columns of an exploded finding struct ``f``."""
    c = F.col(f)
    return [
        c["signal"].alias("signal"),
        sev.rule_id(c["signal"], rule_prefix).alias("rule_id"),
        c["severity"].alias("severity"),
        sev.rank(c["severity"]).alias("severity_rank"),
        c["pass"].alias("pass"),
        F.col("path"),
        F.when(F.col("path").isNull(), c["matched_text"])
        .otherwise(F.concat(F.col("path"), F.lit(": "), c["matched_text"]))
        .alias("matched_text"),
        c["detail"].alias("detail"),
        c["corpus_refs"].alias("corpus_refs"),
        F.lit(False).alias("suppressed"),
    ]
