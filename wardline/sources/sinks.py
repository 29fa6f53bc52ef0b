"""Reports as DataFrames of lines or documents, and writers for them.

Rows stay spread over tasks; only the one-row totals come together.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import severity as sev
from wardline.functions.keys import same_keys
from wardline.functions.text import fingerprint
from wardline.operators.evaluate import scan_totals
from wardline.operators.sequence import trail_lines
from wardline.operators.suppress import add_suppressions
from wardline.rules import signals as S
from wardline.sources.readers import read_suppressions
from wardline.sources.staging import stage

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"

#: After so long, a claim on a version of the suppression table counts as left behind.
CLAIM_SECONDS = 600


def findings_json(findings: DataFrame) -> DataFrame:
    """The report columns of a finding under their report names."""
    return findings.select(
        F.col("tool_name").alias("tool"), "signal", "severity", F.col("matched_text").alias("matched"), "detail",
        "corpus_refs", "suppressed",
    )


def write_findings_json(findings: DataFrame, tools: DataFrame, path: str, mode: str = "error") -> None:
    """``path/findings`` with one JSON object per finding, ``path/totals`` with one row. The scan runs once."""
    findings = stage(findings)
    findings_json(findings).write.mode(mode).json(f"{path}/findings")
    scan_totals(findings, tools).write.mode(mode).json(f"{path}/totals")


def report_header(totals: DataFrame) -> Column:
    """Headline of a text report from the one-row totals."""
    tools = F.concat(F.col("tools_scanned").cast("string"), F.lit(" tool(s)"))
    return (
        F.when((F.col("active") == 0) & (F.col("suppressed") == 0),
               F.concat(F.lit("No issues found in "), tools, F.lit(".")))
        .when(F.col("active") == 0, F.concat(F.lit("No active issues in "), tools, F.lit(".")))
        .otherwise(F.concat(F.col("active").cast("string"), F.lit(" finding(s) in "), tools, F.lit(":")))
    )


def finding_lines(findings: DataFrame) -> DataFrame:
    """section, tool_name, signal, text: the lines of each finding as one text. Section 1 active, 3 suppressed."""
    refs = F.when(F.size("corpus_refs") > 0, F.concat(
        F.lit("\n  refs:    "), F.array_join("corpus_refs", ", ")
    )).otherwise("")
    active = F.concat(
        F.lit("["), F.col("severity"), F.lit("] "), F.col("tool_name"), F.lit(" — "), F.col("signal"), F.lit(" ("),
        F.col("detail"), F.lit(")\n  matched: "), F.col("matched_text"), refs, F.lit("\n"),
    )
    accepted = F.concat(F.lit("  [suppressed] "), F.col("tool_name"), F.lit(" — "), F.col("signal"))
    return findings.select(
        F.when(F.col("suppressed"), 3).otherwise(1).alias("section"), "tool_name", "signal",
        F.when(F.col("suppressed"), accepted).otherwise(active).alias("text"),
    )


def findings_report(findings: DataFrame, tools: DataFrame) -> DataFrame:
    """The text report as ordered rows (section, tool_name, signal, text)."""
    totals = scan_totals(findings, tools)
    blank = F.lit("")
    head = totals.select(
        F.lit(0).alias("section"), blank.alias("tool_name"), blank.alias("signal"),
        F.concat(report_header(totals), F.when(F.col("active") + F.col("suppressed") > 0, "\n").otherwise("")).alias(
            "text"
        ),
    )
    accepted = totals.where("suppressed > 0").select(
        F.lit(2).alias("section"), blank.alias("tool_name"), blank.alias("signal"),
        F.concat(F.col("suppressed").cast("string"), F.lit(" suppressed finding(s):")).alias("text"),
    )
    return head.unionByName(accepted).unionByName(finding_lines(findings)).orderBy(
        "section", "tool_name", "signal", "text"
    )


def write_findings_report(findings: DataFrame, tools: DataFrame, path: str, mode: str = "error") -> None:
    """Text files that read in file order as one report (range partitioned, not gathered)."""
    findings_report(stage(findings), tools).select("text").write.mode(mode).text(path)


def write_trail_report(findings: DataFrame, calls: DataFrame, path: str, run: Sequence[str] = ("run_id",), mode: str = "error") -> None:
    """Text files that read in file order: each run's calls, each call's findings below it.

    Lines are dealt by ranges of run and step, so a long run is many files and no task holds it.
    """
    order = [*run, "step", "place", "line"]
    lines = trail_lines(findings, calls, run).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode(mode).text(path)


def sarif_results(findings: DataFrame, prefix: str = "WARD") -> DataFrame:
    """Add ``result``: the SARIF result object of a finding as JSON text."""
    empty = "array<struct<kind:string,justification:string>>"
    suppressions = F.when(F.col("suppressed"), F.array(F.struct(
        F.lit("external").alias("kind"), F.lit("listed in the suppression table").alias("justification")
    ))).otherwise(F.lit(None).cast(empty))
    mark = fingerprint(F.col("tool_name"), F.col("signal"), F.col("matched_text"))
    result = F.struct(
        sev.rule_id(F.col("signal"), prefix).alias("ruleId"),
        sev.sarif_level(F.col("severity")).alias("level"),
        F.struct(F.concat_ws(": ", "detail", "matched_text").alias("text")).alias("message"),
        F.array(F.struct(F.array(F.struct(
            F.col("tool_name").alias("name"), F.lit("function").alias("kind")
        )).alias("logicalLocations"))).alias("locations"),
        F.struct(mark.alias("primaryLocationLineHash/v1")).alias("partialFingerprints"),
        suppressions.alias("suppressions"),
    )
    return findings.withColumn("result", F.to_json(result))


def sarif_rules(prefix: str = "WARD") -> Column:
    """The rule catalog as a SARIF rules array (a constant)."""
    rules = [
        F.struct(
            F.lit(S.rule_id(name, prefix)).alias("id"),
            F.lit("".join(part.capitalize() for part in name.split("_"))).alias("name"),
            F.struct(F.lit(about).alias("text")).alias("shortDescription"),
            F.struct(F.lit("error").alias("level")).alias("defaultConfiguration"),
            F.struct(F.array(*[F.lit(t) for t in tags.split()]).alias("tags")).alias("properties"),
        )
        for name, tags, about in S.SIGNALS
    ]
    return F.array(*rules)


def sarif_documents(findings: DataFrame, run: str | None = None, prefix: str = "WARD") -> DataFrame:
    """One SARIF 2.1.0 document per run as lines: run_id, part, line.

    In the order of part and line they are the document: the opening with the
    rules, one result per line with the comma before it, the closing. Any number
    of findings is one document, and no row ever holds a whole run. Equal
    results are counted first, so the only thing gathered per run is its first
    result. Without ``run`` all findings are one run, which a clean scan also has.
    """
    run_id = (F.col(run) if run else F.lit("scan")).cast("string").alias("run_id")
    counted = sarif_results(findings, prefix).groupBy(run_id, "result").agg(F.count("*").alias("n"))
    firsts = counted.groupBy("run_id").agg(F.min("result").alias("first"))
    if run is None:
        runs = findings.sparkSession.range(1).select(F.lit("scan").alias("run_id"))
    else:
        runs = firsts.select("run_id")
    opening = F.concat(
        F.lit('{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":'),
        F.to_json(F.struct(F.lit("wardline").alias("name"), F.lit("1.0").alias("version"), sarif_rules(prefix).alias("rules"))),
        F.lit('},"results":['),
    )
    told = (
        counted.alias("l").join(firsts.alias("r"), same_keys("l", "r", ["run_id"]))
        .select("l.run_id", "result", "first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
    )
    is_first = (F.col("result") == F.col("first")) & (F.col("k") == 1)
    results = told.select(
        "run_id", F.when(is_first, 1).otherwise(2).alias("part"), F.concat(F.when(is_first, "").otherwise(","), "result").alias("line")
    )
    return (
        runs.select("run_id", F.lit(0).alias("part"), opening.alias("line"))
        .unionByName(results)
        .unionByName(runs.select("run_id", F.lit(3).alias("part"), F.lit("]}]}").alias("line")))
    )


def write_sarif(findings: DataFrame, path: str, run: str | None = None, mode: str = "error", **options) -> None:
    """A folder per run, whose files in name order are its document (range partitioned, not gathered)."""
    order = ["run_id", "part", "line"]
    lines = sarif_documents(findings, run, **options).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("run_id", "line").write.mode(mode).partitionBy("run_id").text(path)


def benchmark_json(report: DataFrame) -> DataFrame:
    """The report row as one JSON text with its fixed keys."""
    keys = ["tools_total", "tp", "fp", "fn", "tn", "precision", "recall", "f1"]
    return report.select(F.to_json(F.struct(*keys)).alias("report"))


def benchmark_lines(report: DataFrame) -> DataFrame:
    """The report row as text lines with three decimals."""
    n = lambda c: F.col(c).cast("string")
    d = lambda c: F.format_number(c, 3)
    lines = F.array(
        F.concat(F.lit("Benchmark results ("), n("tools_total"), F.lit(" tools):")), F.lit(""),
        F.concat(F.lit("  True positives:  "), n("tp")), F.concat(F.lit("  False positives: "), n("fp")),
        F.concat(F.lit("  False negatives: "), n("fn")), F.concat(F.lit("  True negatives:  "), n("tn")), F.lit(""),
        F.concat(F.lit("  Precision: "), d("precision")), F.concat(F.lit("  Recall:    "), d("recall")),
        F.concat(F.lit("  F1:        "), d("f1")),
    )
    return report.select(F.posexplode(lines).alias("line", "text"))


def write_benchmark(report: DataFrame, path: str, as_text: bool = False, mode: str = "error") -> None:
    if as_text:
        benchmark_lines(report).orderBy("line").select("text").write.mode(mode).text(path)
    else:
        benchmark_json(report).write.mode(mode).text(path)


class SuppressionConflict(RuntimeError):
    """Another writer has replaced, or is replacing, the suppression table that an update started from."""


def write_suppressions(entries: DataFrame, path: str, expected: int | None = None) -> int:
    """Replace the suppression table at ``path``; returns the number of the new version.

    The new table is a folder of its own below ``path``. It is put in place by a
    pointer file that names it, with the next number; readers take the highest.
    So there is a whole table at any time, and a failed job leaves the old one
    as it was. Before that the number is claimed, by creating a file that only
    one writer can create, and the table in place must still be the one with the
    number ``expected`` (by default, the one there at the start): of two writers
    who start from one version the second is refused and nothing of it stays. A
    claim that its writer has not used for ten minutes no longer counts. Older
    tables are deleted last.
    """
    spark = entries.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    latest = suppression_version(spark, path)
    base = latest if expected is None else expected
    folder = f"table-{uuid.uuid4().hex}"
    claim, pointer = make(f"{path}/.claim-{base + 1:09d}"), make(f"{path}/current-{base + 1:09d}-{folder}")
    claimed = False
    try:
        if latest != base:
            raise SuppressionConflict(f"the suppression table at {path} has version {latest}, not {base}")
        entries.select("tool", "signal", "reason").write.parquet(f"{path}/{folder}")
        claimed = _claim(files, claim)
        if not claimed or suppression_version(spark, path) != base:
            raise SuppressionConflict(f"version {base} of the suppression table at {path} has been replaced meanwhile")
        old = suppression_versions(spark, path)
        if not files.createNewFile(pointer):
            raise OSError(f"could not put the new suppression table in place at {path}")
    except Exception:
        files.delete(make(f"{path}/{folder}"), True)
        raise
    finally:
        if claimed:
            files.delete(claim, False)
    for n, gone in old:
        files.delete(make(f"{path}/current-{n:09d}-{gone}"), False)
        files.delete(make(f"{path}/{gone}"), True)
    return base + 1


def _claim(files, claim) -> bool:
    """Create a file that marks a number as taken; a mark left behind by a writer that died is taken over."""
    if files.createNewFile(claim):
        return True
    try:
        left = files.getFileStatus(claim).getModificationTime()
    except Exception:  # its owner has just finished
        return False
    return left < (time.time() - CLAIM_SECONDS) * 1000 and files.delete(claim, False) and files.createNewFile(claim)


def update_suppressions(spark: SparkSession, path: str, new: DataFrame, attempts: int = 3) -> DataFrame:
    """Add entries to the suppression table at ``path``; those whose (tool, signal) is taken come back.

    The table read and the number written belong together, so no other writer's
    entries are lost; after a conflict the update starts again from what is
    there then.
    """
    for left in reversed(range(attempts)):
        version = suppression_version(spark, path)
        try:
            entries, rejected = add_suppressions(read_suppressions(spark, path), new)
            rejected = stage(rejected)  # it reads the table that is about to go
            write_suppressions(entries, path, version)
            return rejected
        except Exception as error:  # also a table that another writer has deleted under the reader
            conflict = isinstance(error, SuppressionConflict) or suppression_version(spark, path) != version
            if not left or not conflict:
                raise
    raise ValueError("attempts must be at least 1")


def suppression_version(spark: SparkSession, path: str) -> int:
    """Number of the suppression table in place, 0 for none."""
    return max((n for n, _ in suppression_versions(spark, path)), default=0)


def suppression_versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the tables that pointer files name, oldest first."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in files.globStatus(make(f"{path}/current-*")) or []]
    return sorted((int(n), folder) for _, n, folder in (name.split("-", 2) for name in names))
