"""Whole jobs: scan, audit of recorded sessions, benchmark."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline.functions.findings import FINDING_COLUMNS
from wardline.functions.text import tag_server
from wardline.operators.definitions import scan_tools
from wardline.operators.drift import definition_drift
from wardline.operators.evaluate import benchmark_report, gate, per_server_counts, scan_totals
from wardline.operators.rpc import classify_replies, reply_findings
from wardline.operators.scan import scan_responses, scan_surface
from wardline.operators.sequence import analyze_chains
from wardline.operators.suppress import apply_suppressions, stale_suppressions
from wardline.sources.readers import read_labelled, read_suppressions, read_tools
from wardline.sources.staging import stage


@dataclass
class Report:
    """Findings with what belongs to them."""

    findings: DataFrame
    totals: DataFrame
    stale: DataFrame
    blocking: DataFrame


def report(findings: DataFrame, tools: DataFrame, suppressions: DataFrame) -> Report:
    """Parts of a report. The findings are staged first, as every part reads them."""
    marked = stage(apply_suppressions(findings, suppressions))
    return Report(marked, scan_totals(marked, tools), stale_suppressions(suppressions, marked), gate(marked))


def scan_with_totals(tools: DataFrame, scan: Callable[[DataFrame], DataFrame], suppressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(findings, totals)`` of a scan whose input is read once: the scanned rows are counted as they pass.

    The scan writes its findings without a shuffle, so the count is of tasks that
    each count once, also when executors are lost; active and suppressed ones
    are counted afterwards, from what was written. Calling this runs the scan.
    """
    seen = Observation(f"scan-{uuid.uuid4().hex}")
    found = stage(scan(tools.observe(seen, F.count(F.lit(1)).alias("tools_scanned"))))
    marked = apply_suppressions(found, suppressions)
    totals = marked.agg(F.count_if(~F.col("suppressed")).alias("active"), F.count_if("suppressed").alias("suppressed"))
    return marked, totals.withColumn("tools_scanned", F.lit(seen.get["tools_scanned"]))


def scan_report(spark: SparkSession, path: str, suppressions: str) -> Report:
    """Scan of listing documents, which are read once: findings, totals, stale suppressions, gate."""
    accepted = read_suppressions(spark, suppressions)
    marked, totals = scan_with_totals(read_tools(spark, path), scan_tools, accepted)
    marked = stage(marked)
    return Report(marked, totals, stale_suppressions(accepted, marked), gate(marked))


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents to one row of counts, precision, recall and f1."""
    labelled = read_labelled(spark, path)
    return benchmark_report(labelled, scan_tools(labelled))


def audit_tables(
    tools: DataFrame,
    surfaces: DataFrame | None = None,
    later_tools: DataFrame | None = None,
    responses: DataFrame | None = None,
    chains: DataFrame | None = None,
    probes: DataFrame | None = None,
) -> DataFrame:
    """All findings of recorded sessions, one module per table that is given."""
    parts = [scan_tools(tools)]
    if surfaces is not None:
        parts.append(scan_surface(surfaces))
    if later_tools is not None:
        parts.append(definition_drift(tools, later_tools))
    if responses is not None:
        parts.append(scan_responses(responses))
    if chains is not None:
        parts.append(analyze_chains(chains, tools))
    if probes is not None:
        parts.append(reply_findings(classify_replies(probes)))
    out = parts[0].select(*FINDING_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FINDING_COLUMNS))
    return out


def audit_servers(servers: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(findings, counts per server)`` for tools with a ``server`` column; names become ``server/tool``."""
    found = scan_tools(tools, keep=["server"]).withColumn("tool_name", tag_server(F.col("server"), F.col("tool_name")))
    return found, per_server_counts(servers, found)
