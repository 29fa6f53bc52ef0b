"""Ordered call logs: flags on arguments, difference to a baseline, findings with their trail.

A call log has one row per call: run columns, ``step`` (0-based), ``tool`` and
``args`` (JSON text). Order is always a column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import severity as sev
from wardline.functions.constants import lookup
from wardline.functions.findings import bind
from wardline.functions.jsontext import canonical_json, json_key, object_keys, raw_leaves, unescaped
from wardline.functions.keys import same_keys
from wardline.functions.positions import with_positions
from wardline.functions.text import ascii_lower
from wardline.rules import signals as S
from wardline.rules import words as W
from wardline.sources.staging import stage

RUN = ("run_id",)
_MARKER = "(?i)" + "|".join(re.escape(m) for m in W.CREDENTIAL_MARKERS)
_OUTSIDE = "(?i)^https?://(?!" + "|".join(re.escape(h) for h in W.LOCAL_HOSTS) + ")"
_OUTSIDE_RAW = '(?i)"https?://(?!' + "|".join(re.escape(h) for h in W.LOCAL_HOSTS) + ")"
_TRAIL_CHUNK = 256
#: Calls of a chunk of a rope, and chunks of a stretch.
_ROPE = 4096


def call_log(df: DataFrame, run: Sequence[str] = RUN, ts: str = "ts", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Add ``step``: the 0-based position of a call in its run, by time and then ``tie``; calls without a time come first.

    A run, an hour of it or the calls without a time may hold most of all calls;
    none of them is one task. Calling this runs a job, which sorts the calls.
    """
    return with_positions(df, run, [ts, *tie], "step")


def argument_flags(args: Column) -> Column:
    """Struct (credential, outside): what the string values of the arguments contain.

    ``credential``: some value contains a credential marker. ``outside``: some
    value starts with an http(s) URL whose host does not start like a local
    one. Only texts that hold a marker, a URL or a backslash (an escape may
    hide either) are parsed at all. A text that cannot be read is flagged by
    its raw form and by the strings that stand whole in it; these are cut out
    only where a backslash could make them differ from the raw form.
    """
    no, low = F.lit(False), ascii_lower(args)
    holds = lambda *parts: reduce(or_, [F.contains(low, F.lit(p)) for p in parts])
    escaped, marked = F.contains(args, F.lit("\\")), holds(*W.CREDENTIAL_MARKERS)
    linked = holds('"http://', '"https://')

    def flags(text: Column) -> Column:
        credential = F.exists(raw_leaves(text), lambda s: s.rlike(_MARKER))
        outside = F.exists(raw_leaves(text), lambda s: s.rlike(_OUTSIDE))
        hidden = lambda pattern: escaped & F.exists(unescaped(raw_leaves(args)), lambda s: s.rlike(pattern))
        raw = F.struct(
            (marked | hidden(_MARKER)).alias("credential"), (args.rlike(_OUTSIDE_RAW) | hidden(_OUTSIDE)).alias("outside")
        )
        return F.when(text.isNull(), raw).otherwise(
            F.struct(credential.alias("credential"), outside.alias("outside"))
        )

    return F.when(escaped | marked | linked, bind(canonical_json(args), flags)).otherwise(
        F.struct(no.alias("credential"), no.alias("outside"))
    )


def flag_calls(calls: DataFrame, args: str = "args") -> DataFrame:
    """Add boolean columns ``credential`` and ``outside``."""
    return calls.withColumn("_f", argument_flags(F.col(args))).select(
        *calls.columns, F.col("_f.credential").alias("credential"), F.col("_f.outside").alias("outside")
    )


def _argument_key() -> Column:
    """Digest of the arguments as compared: canonical JSON, absent as null, unreadable ones as they stand.

    Whole texts would be shuffled, and a side that looks small by its compressed files broadcast.
    """
    return F.unhex(F.sha2(F.coalesce(json_key(F.col("args")), F.lit("null")), 256))


def diff_calls(calls: DataFrame, baseline: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Add ``change``: 'injected', 'diverged' or 'same' against the baseline calls with the same ``by`` columns.

    Injected: the tool is not in the baseline. Diverged: it is, but never with
    equal arguments. The baseline is reduced to distinct rows before each join,
    so a repeated baseline call adds nothing to it, and the larger join is on
    the finest key, with a digest in place of the arguments.
    """
    key = _argument_key()
    base = baseline.select(*by, "tool", key.alias("_args")).distinct()
    tools = baseline.select(*by, "tool").distinct().withColumn("_tool_known", F.lit(True))
    return (
        calls.withColumn("_args", key)
        .join(tools, [*by, "tool"], "left")
        .join(base.withColumn("_call_known", F.lit(True)), [*by, "tool", "_args"], "left")
        .withColumn(
            "change",
            F.when(F.col("_tool_known").isNull(), "injected")
            .when(F.col("_call_known").isNull(), "diverged")
            .otherwise("same"),
        )
        .select(*calls.columns, "change")
    )


def injected_calls(calls: DataFrame, baseline: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Calls to tools the baseline never used."""
    return calls.join(baseline.select(*by, "tool").distinct(), [*by, "tool"], "left_anti").select(*calls.columns)


def diverged_calls(calls: DataFrame, baseline: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Calls to baseline tools with arguments the baseline never used."""
    return diff_calls(calls, baseline, by).where(F.col("change") == "diverged").drop("change")


def contaminated_calls(calls: DataFrame, baseline: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Diverged calls with a credential path or an outside URL. Only flagged calls are joined at all."""
    flagged = flag_calls(calls).where(F.col("credential") | F.col("outside"))
    return diverged_calls(flagged, baseline, by).select(*calls.columns)


def sequence_severity(signal: Column) -> Column:
    """Severity of a sequence signal by its scope and impact score."""
    scores = {name: row for name, *row in S.SEQUENCE_SCORES}
    part = lambda i: lookup({n: r[i] for n, r in scores.items()}, signal)
    return sev.score_severity(sev.score(part(0), part(1), part(2)))


# Our wording of the evidence; %s is the tool.
EVIDENCE = {
    "runtime_credential_access": "call to %s names a credential file in its arguments",
    "unexpected_network_call": "call to %s carries an outside URL in its arguments",
    "unexpected_tool_sequence": "call to %s has no counterpart in the baseline run",
    "cross_tool_contamination": "call to %s has sensitive arguments that the baseline run did not have",
}


def analyze(
    calls: DataFrame,
    baseline: DataFrame | None = None,
    run: Sequence[str] = RUN,
    by: Sequence[str] | None = None,
    with_baseline: DataFrame | None = None,
) -> DataFrame:
    """run columns, step, tool, signal, severity, evidence of every anomaly.

    Without a baseline only the argument flags are looked at. An empty baseline
    is a baseline: every call is then injected. ``by`` says which columns tie a
    call to its baseline (default: the run columns; ``()`` for one baseline for
    all). ``with_baseline`` limits the comparison to the runs it lists.
    """
    by = tuple(run if by is None else by)
    df = flag_calls(calls)
    sensitive = F.col("credential") | F.col("outside")
    raised = {"runtime_credential_access": F.col("credential"), "unexpected_network_call": F.col("outside")}
    if baseline is not None:
        # Equal arguments are equally sensitive, so only sensitive calls of either side are compared by arguments.
        tools = baseline.select(*by, "tool").distinct().withColumn("_tool_known", F.lit(True))
        same = flag_calls(baseline).where(sensitive).select(*by, "tool", _argument_key().alias("_args")).distinct()
        df = (
            df.withColumn("_args", F.when(sensitive, _argument_key()))
            .join(tools, [*by, "tool"], "left")
            .join(same.withColumn("_call_known", F.lit(True)), [*by, "tool", "_args"], "left")
        )
        compared = F.lit(True)
        if with_baseline is not None:
            has = with_baseline.select(*by).distinct().withColumn("_compared", F.lit(True))
            df = df.join(has, list(by), "left")
            compared = F.coalesce("_compared", F.lit(False))
        known, unseen = F.col("_tool_known").isNotNull(), F.col("_call_known").isNull()
        raised["unexpected_tool_sequence"] = compared & ~known
        raised["cross_tool_contamination"] = compared & known & sensitive & unseen
    signals = F.array_compact(F.array(*[F.when(cond, name) for name, cond in raised.items()]))
    found = df.select(*run, "step", "tool", F.explode(signals).alias("signal"))
    return found.select(
        *run, "step", "tool", "signal",
        sequence_severity(F.col("signal")).alias("severity"),
        F.replace(lookup(EVIDENCE, F.col("signal")), F.lit("%s"), F.col("tool")).alias("evidence"),
    )


def dedupe_step_signal(findings: DataFrame, order: Sequence[str], run: Sequence[str] = RUN) -> DataFrame:
    """First finding per (run, step, signal) in the given order; a partial aggregate, not a window."""
    keys = [*run, "step", "signal"]
    rest = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    ).select(*findings.columns)


def call_label(tool: Column, args: Column) -> Column:
    """``tool(key,key)`` with sorted argument names."""
    return F.concat(tool, F.lit("("), F.array_join(object_keys(args), ","), F.lit(")"))


def reproduction_trail(findings: DataFrame, calls: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Add ``trail``: the labels of all calls of the run up to the step of the finding.

    Calls are first gathered in chunks of 256 steps, which bounds every group.
    A finding then asks for the chunks up to its own by (run, chunk), so the
    work on a long run spreads over its chunks; its own row is the only place
    where the trail comes together.
    """
    run = list(run)
    needed = findings.groupBy(*run).agg(F.max("step").alias("_last"))  # runs without findings stay out of the shuffle
    chunks = (
        calls.join(needed, run)
        .where(F.col("step") <= F.col("_last"))
        .select(*run, "step", call_label(F.col("tool"), F.col("args")).alias("label"))
        .groupBy(*run, F.floor(F.col("step") / _TRAIL_CHUNK).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("step", "label"))).alias("calls"))
    )
    rest = [c for c in findings.columns if c not in (*run, "step")]
    asked = (
        findings.groupBy(*run, "step")
        .agg(F.collect_list(F.struct(*rest)).alias("_rest"))  # the findings of one call
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("step") / _TRAIL_CHUNK))))
    )
    pieces = asked.join(chunks, [*run, "chunk"]).select(
        *run, "step", "chunk", "_rest",
        F.transform(F.filter("calls", lambda c: c["step"] <= F.col("step")), lambda c: c["label"]).alias("labels"),
    )
    whole = F.array_sort(F.collect_list(F.struct("chunk", "labels")))
    trails = pieces.groupBy(*run, "step").agg(F.first("_rest").alias("_rest"), whole.alias("_pieces"))
    return trails.select(
        *run, "step", F.flatten(F.transform("_pieces", lambda p: p["labels"])).alias("trail"),
        F.explode("_rest").alias("_f"),
    ).select(*run, "step", *[F.col(f"_f.{c}").alias(c) for c in rest], "trail").select(*findings.columns, "trail")


def provenance(chain_id: Column, record_id: Column) -> Column:
    """``[chain ID] `` or ``[chain ID · RECORD] ``."""
    return F.when(record_id.isNull(), F.concat(F.lit("[chain "), chain_id, F.lit("] "))).otherwise(
        F.concat(F.lit("[chain "), chain_id, F.lit(" · "), record_id, F.lit("] "))
    )


def to_findings(anomalies: DataFrame, run: Sequence[str] = RUN, prefix: Column | None = None) -> DataFrame:
    """Anomalies with a trail, or with a rope's ``trail_calls`` and ``trail_hash``, in the shape of the findings table."""
    if "trail" in anomalies.columns:
        told = F.array_join("trail", " → ")
    else:
        told = F.concat(F.lit("calls 1-"), F.col("trail_calls").cast("string"), F.lit(" of the run, trail "), F.col("trail_hash"))
    detail = F.concat(
        prefix if prefix is not None else F.lit(""), F.lit("chain step "), (F.col("step") + 1).cast("string"), F.lit(": "), told,
    )
    return anomalies.select(
        *run,
        F.col("tool").alias("tool_name"),
        "signal",
        sev.rule_id(F.col("signal")).alias("rule_id"),
        "severity",
        sev.rank(F.col("severity")).alias("severity_rank"),
        F.lit("sequence").alias("pass"),
        F.lit(None).cast("string").alias("path"),
        F.col("evidence").alias("matched_text"),
        detail.alias("detail"),
        F.array().cast("array<string>").alias("corpus_refs"),
        F.lit(False).alias("suppressed"),
    )


def keep_available(steps: DataFrame, tools: DataFrame, tool: str = "tool", name: str = "name"):
    """``(kept, dropped)`` steps by whether their tool is offered."""
    offered = tools.select(F.col(name).alias(tool)).distinct()
    return steps.join(offered, tool, "left_semi"), steps.join(offered, tool, "left_anti")


def analyze_chains(chains: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Findings of scripted chains (id, corpus_record_id, baseline, steps), as ``run_id`` with the chain's id.

    Chains are told apart by their document and position in it, where the table
    has them (``path``, ``position``), so that repeated ids do not mix; else by
    id. Steps with a tool that is not offered leave no trace in the log. A chain
    without baseline steps is not compared; one whose baseline steps were all
    dropped is compared with an empty log. The anomalies are staged, as the trail
    reads them twice, so calling this runs a job.
    """
    place = ("path", "position") if {"path", "position"} <= set(chains.columns) else ("id",)
    run = tuple(f"chain_{c}" for c in place)
    chains = chains.select("*", *[F.col(c).alias(f"chain_{c}") for c in place])

    def log(steps: str) -> DataFrame:
        rows = chains.select(*run, F.posexplode(steps).alias("at", "s")).select(
            *run, "at", F.col("s.tool").alias("tool"), F.col("s.args").alias("args")
        )
        if tools is not None:
            rows = keep_available(rows, tools)[0]
        order = Window.partitionBy(*run).orderBy("at")  # bounded by one chain document
        return rows.select(*run, (F.row_number().over(order) - 1).cast("bigint").alias("step"), "tool", "args")

    calls = log("steps")
    compared = chains.where(F.size("baseline") > 0).select(*run)
    found = stage(analyze(calls, log("baseline"), run=run, with_baseline=compared))
    meta = chains.select(*run, F.col("id").alias("run_id"), "corpus_record_id")
    trails = reproduction_trail(found, calls, run).join(meta, list(run))
    told = to_findings(trails, ("run_id",), provenance(F.col("run_id"), F.col("corpus_record_id")))
    return told


def call_labels(calls: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Run columns, step, label of every call: what trails are made of, stored once."""
    return calls.select(*run, "step", call_label(F.col("tool"), F.col("args")).alias("label"))


def trail_rope(calls: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Run columns, step, label, trail_calls, trail_hash: every call as the end of a trail, told by length and hash.

    A trail's hash adds up hashes of its calls, each with its step, so two trails
    have equal hashes if they are the same calls in the same order, and a trail
    is known without being written out. The sums are made along chunks of steps,
    then along stretches of chunks, then along the run, so no window holds more
    than a few thousand rows per run of millions of calls.
    """
    run = list(run)
    mark = F.xxhash64(F.col("step").cast("bigint"), "label")
    rows = call_labels(calls, run).withColumns({
        "_low": mark.bitwiseAND(F.lit((1 << 32) - 1)), "_high": F.shiftrightunsigned(mark, 32),
        "_chunk": F.floor(F.col("step") / _ROPE), "_stretch": F.floor(F.col("step") / (_ROPE * _ROPE)),
    })
    sums = ("_low", "_high")
    added = lambda df, keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    def before(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})

    chunks = added(rows, [*run, "_stretch", "_chunk"])
    stretches = before(added(chunks, [*run, "_stretch"]), run, "_stretch")
    offsets = before(chunks, [*run, "_stretch"], "_chunk").alias("l").join(
        stretches.alias("r"), same_keys("l", "r", [*run, "_stretch"])
    ).select(*[F.col(f"l.{c}") for c in (*run, "_chunk")], *[(F.col(f"l.{c}_before") + F.col(f"r.{c}_before")).alias(f"{c}_from") for c in sums])
    inside = Window.partitionBy(*run, "_chunk").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = rows.withColumns({f"{c}_to": F.sum(c).over(inside) for c in sums})
    joined = along.alias("l").join(offsets.alias("r"), same_keys("l", "r", [*run, "_chunk"]))
    half = lambda c: F.lpad(F.lower(F.hex((F.col(f"{c}_to") + F.col(f"{c}_from")).bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")
    return joined.select(
        *[F.col(f"l.{c}") for c in (*run, "step", "label")], (F.col("step") + 1).alias("trail_calls"),
        F.concat(half("_high"), half("_low")).alias("trail_hash"),
    )


def rope_reference(findings: DataFrame, rope: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Add ``trail_calls`` and ``trail_hash`` to findings; grows with findings, whatever the length of their trails."""
    run = list(run)
    ends = rope.select(*run, "step", "trail_calls", "trail_hash")
    return findings.alias("l").join(ends.alias("r"), same_keys("l", "r", [*run, "step"])).select("l.*", "r.trail_calls", "r.trail_hash")


def trail_lines(findings: DataFrame, calls: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Run columns, step, place, line: a report in which each call stands once and its findings below it.

    A finding's trail is the calls above it in its run, so the report grows with
    calls and findings, and not with their product as written-out trails do.
    Calls behind a run's last finding, and runs without findings, are left out.
    """
    run = list(run)
    last = findings.groupBy(*run).agg(F.max("step").alias("_last"))
    number = (F.col("step") + 1).cast("string")
    heads = last.select(*run, F.lit(0).cast("bigint").alias("step"), F.lit(0).alias("place"), F.concat_ws(" ", F.lit("run"), *run).alias("line"))
    steps = call_labels(calls, run).alias("l").join(last.alias("r"), same_keys("l", "r", run)).where("step <= _last").select(
        *[F.col(f"l.{c}") for c in run], "step", F.lit(1).alias("place"), F.concat(number, F.lit(". "), "label").alias("line"))
    told = findings.select(
        *run, "step", F.lit(2).alias("place"),
        F.concat(F.lit("  "), "severity", F.lit(" "), "signal", F.lit(": "), "evidence", F.lit(", after calls 1-"), number).alias("line"))
    return heads.unionByName(steps).unionByName(told)


def trail_reference(findings: DataFrame) -> DataFrame:
    """Add ``trail_first`` and ``trail_last``: the steps of the run whose labels are the finding's trail.

    This grows with calls and findings; ``reproduction_trail`` writes the trails
    out, which grows with their product, and is for chosen findings.
    """
    return findings.withColumns({"trail_first": F.lit(0).cast("bigint"), "trail_last": F.col("step")})
