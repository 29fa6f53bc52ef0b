"""Queries on call logs and RPC logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.inputs import cte, source, table
from wardline.functions import jsontext as J
from wardline.functions import severity as sev
from wardline.operators import rpc
from wardline.operators import sequence as seq
from wardline.rules import records as R
from wardline.rules import signals as S
from wardline.rules import words as W
from wardline.sources.staging import stage

CHECKS: dict = {}
FIRST_DAYS = "2024-01-08"


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


# ---- call logs: the first week of events is the baseline run, the rest the observed run ----

def observed(spark, sf):
    return seq.call_log(source(spark, sf, "calls").where(F.col("ts") >= FIRST_DAYS))


def baseline(spark, sf):
    return source(spark, sf, "calls").where(F.col("ts") < FIRST_DAYS)


_STEP = "row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS step"
_URL = r"'^https?://(localhost|127\.0\.0\.1|\[::1\])'"
_CALLS = f"""{cte('calls')},
  obs AS (SELECT *, {_STEP} FROM calls WHERE ts >= TIMESTAMP '{FIRST_DAYS}'),
  base AS (SELECT * FROM calls WHERE ts < TIMESTAMP '{FIRST_DAYS}'),
  leaves AS (SELECT c.event_id, {Q.lower("json_extract_string(j.json, j.fullkey)")} AS s
    FROM calls c, json_tree(CAST(c.args AS JSON)) j WHERE j.type = 'VARCHAR'),
  flags AS (SELECT event_id, bool_or({' OR '.join(f"contains(s, '{m}')" for m in W.CREDENTIAL_MARKERS)}) AS credential,
    bool_or(regexp_matches(s, '^https?://') AND NOT regexp_matches(s, {_URL})) AS outside FROM leaves GROUP BY event_id),
  flagged AS (SELECT o.*, CAST(json(o.args) AS VARCHAR) AS canon, coalesce(credential, false) AS credential, coalesce(outside, false) AS outside
    FROM obs o LEFT JOIN flags USING (event_id)),
  changed AS (SELECT f.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM base b WHERE b.run_id = f.run_id AND b.tool = f.tool) THEN 'injected'
    WHEN NOT EXISTS (SELECT 1 FROM base b WHERE b.run_id = f.run_id AND b.tool = f.tool AND CAST(json(b.args) AS VARCHAR) = f.canon) THEN 'diverged'
    ELSE 'same' END AS change FROM flagged f)"""
_EVIDENCE = "CASE signal " + " ".join(
    f"WHEN '{n}' THEN replace('{t}', '%s', tool)" for n, t in seq.EVIDENCE.items()) + " END"
_SEVERITY = "CASE signal WHEN 'unexpected_network_call' THEN 'medium' WHEN 'unexpected_tool_sequence' THEN 'high' ELSE 'critical' END"


def _raised(*conditions: tuple[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT run_id, step, tool, '{n}' AS signal FROM changed WHERE {c}" for n, c in conditions)
    return f"raised AS (SELECT *, {_SEVERITY} AS severity, {_EVIDENCE} AS evidence FROM ({rows}))"


_ALONE = (("runtime_credential_access", "credential"), ("unexpected_network_call", "outside"))
_COMPARED = (*_ALONE, ("unexpected_tool_sequence", "change = 'injected'"),
             ("cross_tool_contamination", "change = 'diverged' AND (credential OR outside)"))


@check(f"WITH {cte('calls')} SELECT run_id, event_id, tool, {_STEP} FROM calls")
def call_log(spark, sf):
    return seq.call_log(source(spark, sf, "calls")).select("run_id", "event_id", "tool", "step")


@check(f"""WITH {cte('calls')}, l AS (SELECT c.event_id, json_extract_string(j.json, j.fullkey) AS s
  FROM calls c, json_tree(CAST(c.args AS JSON)) j WHERE j.type = 'VARCHAR')
  SELECT event_id, array_to_string(list_sort(coalesce(list(s) FILTER (WHERE s IS NOT NULL), [])), '|') AS leaves
  FROM calls LEFT JOIN l USING (event_id) GROUP BY event_id""")
def json_leaves(spark, sf):
    leaves = F.array_join(F.array_sort(J.json_leaves(F.col("args"))), "|")
    return source(spark, sf, "calls").select("event_id", leaves.alias("leaves"))


@check(f"WITH {_CALLS} SELECT event_id, credential, outside FROM flagged")
def argument_flags(spark, sf):
    return seq.flag_calls(observed(spark, sf)).select("event_id", "credential", "outside")


@check(f"WITH {_CALLS} SELECT event_id, tool FROM changed WHERE change = 'injected'")
def injected_calls(spark, sf):
    return seq.injected_calls(observed(spark, sf), baseline(spark, sf)).select("event_id", "tool")


@check(f"WITH {_CALLS} SELECT event_id, tool FROM changed WHERE change = 'diverged'")
def diverged_calls(spark, sf):
    return seq.diverged_calls(observed(spark, sf), baseline(spark, sf)).select("event_id", "tool")


@check(f"WITH {_CALLS} SELECT event_id, tool FROM changed WHERE change = 'diverged' AND (credential OR outside)")
def cross_tool_contamination(spark, sf):
    return seq.contaminated_calls(observed(spark, sf), baseline(spark, sf)).select("event_id", "tool")


@check(f"WITH {_CALLS}, {_raised(*_ALONE)} SELECT * FROM raised")
def analyze_without_baseline(spark, sf):
    return seq.analyze(observed(spark, sf))


@check(f"WITH {_CALLS}, {_raised(*_COMPARED)} SELECT * FROM raised")
def analyze_with_baseline(spark, sf):
    return seq.analyze(observed(spark, sf), baseline(spark, sf))


@check(f"WITH {_CALLS}, {_raised(*_ALONE, ('unexpected_tool_sequence', 'true'))} SELECT * FROM raised")
def analyze_with_empty_baseline(spark, sf):
    return seq.analyze(observed(spark, sf), baseline(spark, sf).where("false"))


@check(f"""WITH {cte('calls')}, b AS (SELECT DISTINCT tool, CAST(json(args) AS VARCHAR) AS canon FROM calls WHERE ts < TIMESTAMP '{FIRST_DAYS}')
  SELECT event_id, CASE WHEN tool NOT IN (SELECT tool FROM b) THEN 'injected'
    WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.tool = c.tool AND b.canon = CAST(json(c.args) AS VARCHAR)) THEN 'diverged'
    ELSE 'same' END AS change FROM calls c WHERE ts >= TIMESTAMP '{FIRST_DAYS}'""")
def diff_against_one_baseline(spark, sf):
    calls = source(spark, sf, "calls")
    got = seq.diff_calls(calls.where(F.col("ts") >= FIRST_DAYS), calls.where(F.col("ts") < FIRST_DAYS), by=())
    return got.select("event_id", "change")


_SCOPES, _IMPACTS = list(S.SCOPE_POINTS.items()), list(S.IMPACT_POINTS.items())


@check(f"""WITH {Q.values(_SCOPES, 'sc', 'scope, sp')}, {Q.values(_IMPACTS, 'im', 'impact, ip')},
  e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'session' ELSE 'cross' END AS scope,
    CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'high' END AS confidentiality,
    CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'high' ELSE 'partial' END AS integrity FROM events),
  p AS (SELECT event_id, sp + a.ip + b.ip AS points FROM e JOIN sc USING (scope) JOIN im a ON a.impact = confidentiality JOIN im b ON b.impact = integrity)
  SELECT event_id, points, CASE WHEN points >= 8 THEN 'critical' WHEN points >= 6 THEN 'high' WHEN points >= 3 THEN 'medium'
    WHEN points > 0 THEN 'low' ELSE 'info' END AS severity FROM p""")
def score_severity(spark, sf):
    k = F.col("event_id")
    scope = F.when(k % 3 == 0, "local").when(k % 3 == 1, "session").otherwise("cross")
    conf = F.when(k % 4 == 0, "none").when(k % 4 == 1, "partial").otherwise("high")
    integ = F.when(k % 5 == 0, "none").when(k % 5 == 1, "high").otherwise("partial")
    rows = source(spark, sf, "calls").select("event_id", sev.score(scope, conf, integ).alias("points"))
    return rows.withColumn("severity", sev.score_severity(F.col("points")))


@check(f"""WITH {cte('calls')}, r AS (SELECT run_id, event_id % 20 AS step, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS signal,
  tool AS evidence, event_id FROM calls)
  SELECT run_id, step, signal, evidence, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step, signal ORDER BY event_id) AS n FROM r) WHERE n = 1""")
def dedupe_step_signal(spark, sf):
    rows = source(spark, sf, "calls").selectExpr(
        "run_id", "event_id % 20 AS step", "CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS signal", "tool AS evidence",
        "event_id")
    return seq.dedupe_step_signal(rows, order=["event_id"])


_LABELS = """labels_ AS (SELECT run_id, step, tool || '(' || CASE WHEN json_type(args) = 'OBJECT'
    THEN array_to_string(list_sort(json_keys(args)), ',') ELSE '' END || ')' AS label FROM obs)"""
_TRAILS = f"""{_LABELS}, trails AS (SELECT f.run_id, f.step, string_agg(l.label, ' → ' ORDER BY l.step) AS trail
    FROM (SELECT DISTINCT run_id, step FROM raised) f JOIN labels_ l ON l.run_id = f.run_id AND l.step <= f.step GROUP BY f.run_id, f.step)"""


@check(f"WITH {_CALLS}, {_raised(*_ALONE)}, {_TRAILS} SELECT run_id, step, signal, trail FROM raised JOIN trails USING (run_id, step)")
def reproduction_trail(spark, sf):
    calls = stage(observed(spark, sf))  # read once for the anomalies and once for the trails
    got = seq.reproduction_trail(stage(seq.analyze(calls)), calls)
    return got.select("run_id", "step", "signal", F.array_join("trail", " → ").alias("trail"))


@check(f"""WITH {_CALLS}, {_raised(*_COMPARED)}, {_TRAILS}
  SELECT run_id, tool AS tool_name, signal, severity, {Q.rank('severity')} AS severity_rank, evidence AS matched_text,
    '[chain ' || run_id || CASE WHEN CAST(run_id AS INT) % 2 = 0 THEN ' · REC-' || run_id ELSE '' END || '] chain step ' || (step + 1) || ': ' || trail AS detail
  FROM raised JOIN trails USING (run_id, step)""")
def sequence_findings(spark, sf):
    calls = stage(observed(spark, sf))
    found = seq.reproduction_trail(stage(seq.analyze(calls, baseline(spark, sf))), calls)
    record = F.when(F.col("run_id").cast("int") % 2 == 0, F.concat(F.lit("REC-"), F.col("run_id")))
    return seq.to_findings(found, prefix=seq.provenance(F.col("run_id"), record)).select(
        "run_id", "tool_name", "signal", "severity", "severity_rank", "matched_text", "detail"
    )


@check(f"""WITH {_CALLS}, {_raised(*_COMPARED)}, {_TRAILS}, e AS (SELECT trail, count(*) AS n FROM raised JOIN trails USING (run_id, step) GROUP BY trail)
  SELECT run_id, step, signal, step + 1 AS trail_calls, n AS n_equal FROM raised JOIN trails USING (run_id, step) JOIN e USING (trail)""")
def equal_trails(spark, sf):
    """Findings with the number of findings that have the same trail, told by ropes without writing a trail."""
    calls = stage(observed(spark, sf))
    found = seq.rope_reference(stage(seq.analyze(calls, baseline(spark, sf))), seq.trail_rope(calls))
    same = found.groupBy("trail_hash", "trail_calls").agg(F.count("*").alias("n_equal"))
    return found.join(same, ["trail_hash", "trail_calls"]).select("run_id", "step", "signal", "trail_calls", "n_equal")


@check(f"""WITH {_CALLS}, {_raised(*_COMPARED)}, {_LABELS}, last AS (SELECT run_id, max(step) AS last FROM raised GROUP BY run_id)
  SELECT run_id, 0 AS step, 0 AS place, 'run ' || run_id AS line FROM last
  UNION ALL SELECT run_id, step, 1, (step + 1) || '. ' || label FROM labels_ JOIN last USING (run_id) WHERE step <= last
  UNION ALL SELECT run_id, step, 2, '  ' || severity || ' ' || signal || ': ' || evidence || ', after calls 1-' || (step + 1) FROM raised""")
def trail_report(spark, sf):
    """The report that tells each call once, as lines."""
    calls = stage(observed(spark, sf))
    return seq.trail_lines(stage(seq.analyze(calls, baseline(spark, sf))), calls)


# A chain document per user: steps are the events of one kind of day, the baseline those of another.
_CHAIN_LOG = f"""{cte('calls')}, all_steps AS (SELECT run_id, event_id, ts, tool, args, CASE WHEN ts >= TIMESTAMP '{FIRST_DAYS}' THEN 'steps' ELSE 'baseline' END AS part FROM calls),
  has AS (SELECT DISTINCT run_id FROM all_steps WHERE part = 'baseline' AND CAST(run_id AS INT) % 3 <> 0),
  kept AS (SELECT * FROM all_steps WHERE tool NOT LIKE '%_3'),
  flagged AS (SELECT k.*, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS step, CAST(json(args) AS VARCHAR) AS canon,
    event_id % 10 = 0 AS credential, event_id % 10 = 1 AS outside FROM kept k WHERE part = 'steps'),
  base AS (SELECT * FROM kept JOIN has USING (run_id) WHERE part = 'baseline'),
  changed AS (SELECT f.*, CASE WHEN run_id NOT IN (SELECT run_id FROM has) THEN 'same'
    WHEN NOT EXISTS (SELECT 1 FROM base b WHERE b.run_id = f.run_id AND b.tool = f.tool) THEN 'injected'
    WHEN NOT EXISTS (SELECT 1 FROM base b WHERE b.run_id = f.run_id AND b.tool = f.tool AND CAST(json(b.args) AS VARCHAR) = f.canon) THEN 'diverged'
    ELSE 'same' END AS change FROM flagged f), obs AS (SELECT * FROM flagged)"""


@check(f"""WITH {_CHAIN_LOG}, {_raised(*_COMPARED)}, {_TRAILS}
  SELECT run_id, tool AS tool_name, signal, severity, '[chain ' || run_id || '] chain step ' || (step + 1) || ': ' || trail AS detail
  FROM raised JOIN trails USING (run_id, step)""")
def analyze_chains(spark, sf):
    calls = source(spark, sf, "calls")
    late = F.col("ts") >= FIRST_DAYS
    entry = F.struct("ts", "event_id", "tool", "args")
    ordered = lambda cond: F.transform(
        F.array_sort(F.collect_list(F.when(cond, entry))), lambda e: F.struct(e["tool"].alias("tool"), e["args"].alias("args")))
    chains = calls.groupBy(F.col("run_id").alias("id")).agg(
        ordered(late).alias("steps"), ordered(~late).alias("_baseline")
    ).select(
        "id", F.lit(None).cast("string").alias("corpus_record_id"), "steps",
        F.when(F.col("id").cast("int") % 3 == 0, F.array().cast("array<struct<tool:string,args:string>>")).otherwise(
            F.col("_baseline")).alias("baseline"),
    )
    tools = calls.where(~F.col("tool").like("%_3")).select(F.col("tool").alias("name"))
    return seq.analyze_chains(chains, tools).select("run_id", "tool_name", "signal", "severity", "detail")


@check(f"""WITH {cte('calls')}, offered AS (SELECT DISTINCT event_type || '_2' AS name FROM events)
  SELECT event_id, tool, tool IN (SELECT name FROM offered) AS kept FROM calls""")
def keep_available(spark, sf):
    calls = source(spark, sf, "calls")
    offered = table(spark, sf, "events").select(F.concat("event_type", F.lit("_2")).alias("name"))
    kept, dropped = seq.keep_available(calls, offered)
    mark = lambda df, value: df.select("event_id", "tool", F.lit(value).alias("kept"))
    return mark(kept, True).unionByName(mark(dropped, False))


# ---- RPC logs ----

_HAS = "json_valid(line) AND json_type(line) = 'OBJECT' AND list_contains(json_keys(line), '{}')"
_CLASS = f"""CASE outcome WHEN 'reply' THEN CASE
    WHEN {_HAS.format('jsonrpc')} AND {_HAS.format('error')} THEN 'graceful'
    WHEN {_HAS.format('jsonrpc')} AND {_HAS.format('result')} THEN 'accepted_invalid' ELSE 'malformed' END
  WHEN 'closed' THEN CASE WHEN crashed THEN 'crash' ELSE 'connection_closed' END
  ELSE CASE WHEN expects_reply THEN 'timeout' ELSE 'graceful' END END"""


@check(f"WITH {cte('probes')} SELECT event_id, {_CLASS} AS reply_class FROM probes")
def classify_replies(spark, sf):
    return rpc.classify_replies(source(spark, sf, "probes")).select("event_id", "reply_class")


@check(f"""WITH {cte('probes')}, {Q.values(R.REPLY_CLASSES, 'classes', 'reply_class, severity, wording')}, c AS (SELECT *, {_CLASS} AS reply_class FROM probes)
  SELECT event_id, label AS tool_name, 'protocol_violation' AS signal, severity,
    CASE WHEN length(probe) > 120 THEN substr(probe, 1, 120) || '…' ELSE probe END AS matched_text,
    'server ' || wording || ' for ' || label AS detail FROM c JOIN classes USING (reply_class) WHERE severity IS NOT NULL""")
def reply_findings(spark, sf):
    got = rpc.reply_findings(rpc.classify_replies(source(spark, sf, "probes")), keep=["event_id"])
    return got.select("event_id", "tool_name", "signal", "severity", "matched_text", "detail")


def _envelope() -> str:
    method = "json_extract_string(v, '$.method')"
    has = lambda k: f"json_type(v, '$.{k}') IS NOT NULL"
    unknown = f"json_type(v, '$.method') = 'VARCHAR' AND {method} NOT IN ({', '.join(Q.quote(m) for m in R.METHODS)}) AND length({method}) < {R.OVERSIZED_METHOD}"
    rules = {
        "not_json": "v IS NULL",
        "empty_object": "CAST(v AS VARCHAR) = '{}'",
        "missing_jsonrpc_field": f"CAST(v AS VARCHAR) <> '{{}}' AND NOT {has('jsonrpc')}",
        "wrong_jsonrpc_version": "json_extract_string(v, '$.jsonrpc') <> '2.0'",
        "id_as_array": "json_type(v, '$.id') = 'ARRAY'",
        "id_as_object": "json_type(v, '$.id') = 'OBJECT'",
        "missing_method": f"CAST(v AS VARCHAR) <> '{{}}' AND NOT {has('method')}",
        "unknown_method": f"{unknown} AND {has('id')}",
        "oversized_method_name": f"length({method}) >= {R.OVERSIZED_METHOD}",
        "unknown_notification": f"{unknown} AND NOT {has('id')}",
    }
    parts = " UNION ALL ".join(f"SELECT session, seq, '{n}' AS violation FROM p WHERE {c}" for n, c in rules.items())
    return f"""WITH {cte('rpc_requests')}, p AS (SELECT session, seq, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM rpc_requests) {parts}"""


@check(_envelope())
def envelope_violations(spark, sf):
    return rpc.envelope_violations(source(spark, sf, "rpc_requests"))


@check(f"""WITH {cte('rpc_requests')}, m AS (SELECT session, min(seq) FILTER (WHERE direction = 'request' AND method = 'initialize') AS opened,
    min(seq) FILTER (WHERE direction = 'closed') AS closed FROM rpc_requests GROUP BY session),
  r AS (SELECT * FROM rpc_requests JOIN m USING (session) WHERE direction = 'request')
  SELECT session, seq, 'tools_call_before_initialize' AS violation FROM r WHERE method = 'tools/call' AND (opened IS NULL OR seq < opened)
  UNION ALL SELECT session, seq, 'tools_list_before_initialize' FROM r WHERE method = 'tools/list' AND (opened IS NULL OR seq < opened)
  UNION ALL SELECT session, seq, 'second_initialize' FROM r WHERE method = 'initialize' AND seq > opened
  UNION ALL SELECT session, seq, 'request_after_close' FROM r WHERE seq > closed""")
def lifecycle_violations(spark, sf):
    return rpc.lifecycle_violations(source(spark, sf, "rpc_requests"))


# Every event is a request; a reply follows after 0.1 times its value in seconds, unless it is an error.
_RPC_LOG = f"""log AS (SELECT CAST(user_id % 7 AS STRING) AS session, event_id AS seq, 'request' AS direction,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 5 AS STRING) END AS id, ts FROM events
  UNION ALL SELECT CAST(user_id % 7 AS STRING), event_id, 'response', CAST(event_id % 5 AS STRING),
    ts + to_microseconds(CAST(floor(value * 100) AS BIGINT) * 1000) FROM events WHERE event_type <> 'error' AND value IS NOT NULL)"""


def rpc_log(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    session = (F.col("user_id") % 7).cast("string").alias("session")
    number = (F.col("event_id") % 5).cast("string")
    requests = events.select(
        session, F.col("event_id").alias("seq"), F.lit("request").alias("direction"),
        F.when(F.col("event_id") % 10 != 0, number).alias("id"), "ts",
    )
    delay = F.floor(F.col("value") * 100).cast("bigint") * 1000
    replies = events.where((F.col("event_type") != "error") & F.col("value").isNotNull()).select(
        session, F.col("event_id").alias("seq"), F.lit("response").alias("direction"), number.alias("id"),
        F.timestamp_micros(F.unix_micros("ts") + delay).alias("ts"),
    )
    return requests.unionByName(replies)


@check(f"""WITH {_RPC_LOG} SELECT q.session, q.seq, q.id, coalesce(epoch_us(min(r.ts)), -1) AS reply_micros,
    CASE WHEN q.id IS NULL THEN 'no_reply_due' WHEN min(r.ts) IS NULL THEN 'silent' ELSE 'answered' END AS status
  FROM log q LEFT JOIN log r ON r.direction = 'response' AND r.session = q.session AND r.id = q.id
    AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL {R.REPLY_SECONDS} SECONDS
  WHERE q.direction = 'request' GROUP BY q.session, q.seq, q.id, q.ts""")
def pair_replies(spark, sf):
    got = rpc.pair_replies(rpc_log(spark, sf))
    micros = F.coalesce(F.unix_micros("reply_ts"), F.lit(-1))
    return got.select("session", "seq", "id", micros.alias("reply_micros"), "status")
