"""JSON-RPC logs: classes of replies, broken envelopes, broken order, replies that never came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import severity as sev
from wardline.functions.constants import lookup
from wardline.functions.findings import bind
from wardline.functions.jsontext import object_keys
from wardline.functions.keys import same_keys
from wardline.functions.text import head_ellipsis
from wardline.rules import records as R

SESSION = ("session",)


def reply_class(outcome: Column, line: Column, crashed: Column, expects_reply: Column) -> Column:
    """Class of what followed a probe. ``outcome`` is 'reply', 'closed' or 'silent'."""
    replied = bind(object_keys(line), lambda keys: (
        F.when(F.array_contains(keys, "jsonrpc") & F.array_contains(keys, "error"), "graceful")
        .when(F.array_contains(keys, "jsonrpc") & F.array_contains(keys, "result"), "accepted_invalid")
        .otherwise("malformed")
    ))
    return (
        F.when(outcome == "reply", replied)
        .when((outcome == "closed") & crashed, "crash")
        .when(outcome == "closed", "connection_closed")
        .when(expects_reply, "timeout")
        .otherwise("graceful")
    )


def classify_replies(df: DataFrame) -> DataFrame:
    """Add ``reply_class`` from columns outcome, line, crashed, expects_reply."""
    return df.withColumn(
        "reply_class", reply_class(F.col("outcome"), F.col("line"), F.col("crashed"), F.col("expects_reply"))
    )


def reply_findings(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Findings of classified probes (label, probe, reply_class); acceptable replies give none."""
    severity = lookup({c: s for c, s, _ in R.REPLY_CLASSES if s}, F.col("reply_class"))
    wording = lookup({c: w for c, _, w in R.REPLY_CLASSES}, F.col("reply_class"))
    signal = F.lit("protocol_violation")
    return df.where(severity.isNotNull()).select(
        *keep,
        F.col("label").alias("tool_name"),
        signal.alias("signal"),
        sev.rule_id(signal).alias("rule_id"),
        severity.alias("severity"),
        sev.rank(severity).alias("severity_rank"),
        F.lit("protocol").alias("pass"),
        F.lit(None).cast("string").alias("path"),
        head_ellipsis(F.col("probe")).alias("matched_text"),
        F.concat(F.lit("server "), wording, F.lit(" for "), F.col("label")).alias("detail"),
        F.array().cast("array<string>").alias("corpus_refs"),
        F.lit(False).alias("suppressed"),
    )


def envelope_rules(raw: Column) -> Column:
    """Names of the envelope rules a request line breaks.

    A method name of ``OVERSIZED_METHOD`` characters or more is reported as
    that and not as unknown as well: the probe it belongs to is about length,
    and a name so long is in no list of methods anyway.
    """
    def rules(v: Column) -> Column:
        part = lambda name: F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
        method = F.try_variant_get(v, "$.method", "string")
        text = F.to_json(v)
        ok, empty = v.isNotNull(), text == "{}"
        unknown = ok & part("method").startswith('"') & ~method.isin(R.METHODS) & (
            F.char_length(method) < R.OVERSIZED_METHOD
        )
        broken = {
            "not_json": ~ok,
            "empty_object": empty,
            "missing_jsonrpc_field": ok & ~empty & part("jsonrpc").isNull(),
            "wrong_jsonrpc_version": part("jsonrpc") != '"2.0"',
            "id_as_array": part("id").startswith("["),
            "id_as_object": part("id").startswith("{"),
            "missing_method": ok & ~empty & part("method").isNull(),
            "unknown_method": unknown & part("id").isNotNull(),
            "oversized_method_name": F.char_length(method) >= R.OVERSIZED_METHOD,
            "unknown_notification": unknown & part("id").isNull(),
        }
        return F.array_compact(F.array(*[F.when(cond, name) for name, cond in broken.items()]))

    return bind(F.try_parse_json(raw), rules)


def envelope_violations(requests: DataFrame, raw: str = "raw", keep: Sequence[str] = ("session", "seq")) -> DataFrame:
    """One row per broken rule: keep columns and ``violation``."""
    return requests.select(*keep, F.explode(envelope_rules(F.col(raw))).alias("violation"))


def lifecycle_violations(log: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    """Calls out of order: session columns, seq, violation.

    Needs seq, direction ('request', 'closed', ...) and method. One small
    pre-aggregated row per session says when it was first initialised and
    closed; the log is joined with that, so no session is walked in one task.
    """
    method, request = F.col("method"), F.col("direction") == "request"
    marks = log.groupBy(*session).agg(
        F.min(F.when(request & (method == "initialize"), F.col("seq"))).alias("_opened"),
        F.min(F.when(F.col("direction").isin("closed", "crashed"), F.col("seq"))).alias("_closed"),
    )
    early = F.col("_opened").isNull() | (F.col("seq") < F.col("_opened"))
    broken = {
        "tools_call_before_initialize": (method == "tools/call") & early,
        "tools_list_before_initialize": (method == "tools/list") & early,
        "second_initialize": (method == "initialize") & (F.col("seq") > F.col("_opened")),
        "request_after_close": F.col("seq") > F.col("_closed"),
    }
    names = F.array_compact(F.array(*[F.when(cond, name) for name, cond in broken.items()]))
    return (
        log.where(request).alias("l")
        .join(marks.alias("m"), same_keys("l", "m", session))
        .select(*[F.col(f"l.{c}") for c in session], "seq", F.explode(names).alias("violation"))
    )


def pair_replies(
    log: DataFrame, session: Sequence[str] = SESSION, seconds: int = R.REPLY_SECONDS, bucket_seconds: int = 60
) -> DataFrame:
    """Each request with the time of its first reply: session columns, seq, id, ts, reply_ts, status.

    A reply has the same session and id and comes at most ``seconds`` later.
    Status is 'answered', 'silent', or 'no_reply_due' for requests without id.
    Requests and replies meet in one sorted window per (session, id, time
    bucket) rather than in a join, so a session that repeats one id makes no
    pairs and splits by time. A reply just after a bucket edge is also offered
    to the bucket before. Going back in time, the nearest reply is carried
    along, so a bucket is one pass however often an id repeats. Requests
    without an id spread by their sequence number.
    """
    width = bucket_seconds * 1_000_000
    reach = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bucket = F.floor(at / width)
    request = F.col("direction") == "request"
    placed = log.where(F.col("direction").isin("request", "response")).select(
        *session, "seq", "id", "ts", at.alias("_at"), request.alias("_request"),
        F.coalesce(F.col("id"), F.concat(F.lit("\u0000"), F.col("seq").cast("string"))).alias("_id"),
        F.explode(
            F.when(~request & (F.pmod(at, F.lit(width)) <= reach), F.array(bucket, bucket - 1)).otherwise(
                F.array(bucket)
            )
        ).alias("_bucket"),
    )
    back = Window.partitionBy(*session, "_id", "_bucket").orderBy(F.col("_at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reply = F.min_by(F.when(~F.col("_request"), F.col("ts")), F.when(~F.col("_request"), F.col("_at"))).over(back)
    near = F.unix_micros(reply.cast("timestamp")) - F.col("_at") <= reach
    paired = placed.withColumn("reply_ts", F.when(near, reply))
    return paired.where("_request").select(*session, "seq", "id", "ts", "reply_ts").withColumn("status", reply_status())


def reply_status() -> Column:
    """'answered', 'silent' or 'no_reply_due', from columns id and reply_ts."""
    return F.when(F.col("id").isNull(), "no_reply_due").when(F.col("reply_ts").isNull(), "silent").otherwise("answered")
