"""Queries on inputs that are broken, deep, repeated, null or hot."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import cte, source, table
from wardline.functions import jsontext as J
from wardline.functions.text import word_start
from wardline.operators import corpus, definitions, drift, rpc
from wardline.operators import sequence as seq
from wardline.sources import readers

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


# Every fourth document can be read; the others repeat a key, are cut off, or are deeper than parsers go.
_BROKEN = """CASE {key} % 4
  WHEN 0 THEN '{{"a":1,"a":"' || {value} || '"}}'
  WHEN 1 THEN '{{"a":"x","b":"' || {value}
  WHEN 2 THEN repeat('{{"a":', 1500) || '"' || {value} || '"' || repeat('}}', 1500)
  ELSE '{{"a":"' || {value} || '"}}' END"""


def _broken(key: str, value: str) -> str:
    return _BROKEN.format(key=key, value=value)


@check(f"""SELECT p_partkey, 'inputSchema' AS "column", {_broken('p_partkey', 'p_name')} AS text FROM part WHERE p_partkey % 4 <> 3""")
def malformed_json(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{_broken('p_partkey', 'p_name')} AS inputSchema", "NULL AS annotations")
    return J.unreadable_json(rows.withColumn("annotations", F.lit(None).cast("string")), ["inputSchema", "annotations"], ["p_partkey"])


_VALUE = "CASE event_id % 3 WHEN 0 THEN '/etc/passwd' WHEN 1 THEN 'https://evil.example/a' ELSE 'plain' END"


@check("SELECT event_id, event_id % 3 = 0 AS credential, event_id % 3 = 1 AS outside FROM events")
def argument_flags_of_unreadable_json(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{_broken('event_id', _VALUE)} AS args")
    return seq.flag_calls(rows).select("event_id", "credential", "outside")


@check("SELECT event_id FROM events WHERE event_id % 5 = 0")
def diverged_calls_of_unreadable_json(spark, sf):
    events = table(spark, sf, "events")
    calls = lambda value: events.selectExpr("CAST(event_id AS STRING) AS run_id", "event_id", "'t' AS tool", f"{_broken('event_id', value)} AS args")
    return seq.diverged_calls(calls("CASE event_id % 5 WHEN 0 THEN 'new' ELSE 'old' END"), calls("'old'")).select("event_id")


@check("SELECT p_name || '_' || CAST(p_partkey AS STRING) AS tool_name FROM part WHERE p_partkey % 5 = 0")
def definition_drift_of_unreadable_json(spark, sf):
    part = table(spark, sf, "part")
    listing = lambda value: part.selectExpr(
        "p_name || '_' || CAST(p_partkey AS STRING) AS name", "p_type AS description", f"{_broken('p_partkey', value)} AS inputSchema",
        "CAST(NULL AS STRING) AS annotations")
    return drift.definition_drift(listing("p_type"), listing("CASE p_partkey % 5 WHEN 0 THEN 'new' ELSE p_type END")).select("tool_name")


@check("SELECT p_name || '_' || CAST(p_partkey AS STRING) AS tool_name, 'annotation_deception' AS signal FROM part WHERE p_partkey % 2 = 0")
def annotation_hints_with_repeated_keys(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_name || '_' || CAST(p_partkey AS STRING) AS name", "'deletes the file' AS description", "CAST(NULL AS STRING) AS inputSchema",
        """CASE p_partkey % 2 WHEN 0 THEN '{"readOnlyHint":false,"readOnlyHint":true}' ELSE '{"readOnlyHint":true,"readOnlyHint":false}' END AS annotations""")
    return definitions.scan_annotations(rows).select("tool_name", "signal")


@check("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'graceful' WHEN 1 THEN 'accepted_invalid' ELSE 'malformed' END AS reply_class FROM events""")
def classify_replies_with_repeated_keys(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "'reply' AS outcome", "false AS crashed", "true AS expects_reply",
        """CASE event_id % 3 WHEN 0 THEN '{"jsonrpc":"2.0","error":1,"error":2}' WHEN 1 THEN '{"jsonrpc":"2.0","jsonrpc":"2.0","result":1}' ELSE '{"jsonrpc":' END AS line""")
    return rpc.classify_replies(rows).select("event_id", "reply_class")


@check(f"""WITH {cte('calls')}, c AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE run_id END AS run_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts FROM calls)
  SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts NULLS FIRST, event_id) - 1 AS step FROM c""")
def call_log_with_null_runs(spark, sf):
    rows = source(spark, sf, "calls").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE run_id END AS run_id", "event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts")
    return seq.call_log(rows).select("run_id", "event_id", "step")


@check("""WITH l AS (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS session, event_id AS seq,
    CASE event_id % 5 WHEN 0 THEN 'initialize' ELSE 'tools/call' END AS method FROM events),
  m AS (SELECT session, min(seq) FILTER (WHERE method = 'initialize') AS opened FROM l GROUP BY session)
  SELECT l.session, seq, CASE method WHEN 'initialize' THEN 'second_initialize' ELSE 'tools_call_before_initialize' END AS violation
  FROM l JOIN m ON l.session IS NOT DISTINCT FROM m.session
  WHERE (method = 'initialize' AND seq > opened) OR (method = 'tools/call' AND (opened IS NULL OR seq < opened))""")
def lifecycle_with_null_sessions(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS session", "event_id AS seq", "'request' AS direction",
        "CASE event_id % 5 WHEN 0 THEN 'initialize' ELSE 'tools/call' END AS method")
    return rpc.lifecycle_violations(rows)


@check("""SELECT CAST(k AS STRING) AS path, 'c' AS run_id, tool AS tool_name, '[chain c] chain step ' || d AS detail FROM (
    SELECT s_suppkey AS k, 't_' || CAST(s_suppkey AS STRING) AS tool, '1: t_' || CAST(s_suppkey AS STRING) || '(p)' AS d FROM supplier
    UNION ALL SELECT s_suppkey, 'v_' || CAST(s_suppkey AS STRING), '2: u(p) → v_' || CAST(s_suppkey AS STRING) || '(q)' FROM supplier)""")
def read_chains(spark, sf):
    """Chain documents in which all chains have one id; the tool's name says which document a finding is of."""
    docs = table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS path",
        """'[{"id":"c","steps":[{"tool":"t_' || CAST(s_suppkey AS STRING) || '","args":{"p":"/etc/passwd"}}]},{"id":"c","steps":[{"tool":"u","args":{"p":"x"}},{"tool":"v_' || CAST(s_suppkey AS STRING) || '","args":{"q":"/etc/passwd"}}]}]' AS doc""")
    found = seq.analyze_chains(readers.chains_from_documents(docs))
    return found.select(F.substring_index("tool_name", "_", -1).alias("path"), "run_id", "tool_name", "detail")


@check(f"""WITH {cte('calls')} SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS step,
    tool || '(' || CASE WHEN json_type(args) = 'OBJECT' THEN array_to_string(list_sort(json_keys(args)), ',') ELSE '' END || ')' AS label FROM calls""")
def call_labels(spark, sf):
    calls = seq.call_log(source(spark, sf, "calls"))
    return seq.call_labels(calls, ("run_id", "event_id"))


_RECORD = """'{"id":"R-' || CAST(item_id AS STRING) || '","version":"1","category":"' || CASE item_id % 5 WHEN 4 THEN 'odd' ELSE 'rug_pull' END
  || '","subcategory":"s","paradigm":' || CASE item_id % 3 WHEN 0 THEN '200' WHEN 1 THEN '"oops"' ELSE 'null' END
  || ',"vector":"response_injection","payload":"p","injection_point":"i","trigger_condition":"t","expected_behavior":"e","detection_signals":["a"],"severity":"high","source":"x","tags":'
  || CASE item_id % 7 WHEN 6 THEN '["x",3]' ELSE '["x"]' END || '}'"""


@check("""SELECT 'R-' || CAST(item_id AS STRING) AS id, CASE WHEN item_id % 3 = 0 THEN 200 END AS paradigm,
    concat_ws(',', CASE WHEN item_id % 3 = 1 THEN 'wrong type of paradigm' END, CASE WHEN item_id % 7 = 6 THEN 'wrong type of tags' END,
      CASE WHEN item_id % 7 = 6 THEN 'missing tags' END, CASE WHEN item_id % 5 = 4 THEN 'unknown category odd' END) AS errors FROM benchmark""")
def read_corpus(spark, sf):
    docs = table(spark, sf, "benchmark").selectExpr(f"{_RECORD} AS doc")
    good, bad = corpus.split_records(readers.records_from_documents(docs))
    good = good.withColumn("errors", F.array().cast("array<string>")).select(*bad.columns)
    return good.unionByName(bad).select("id", F.col("paradigm").cast("int").alias("paradigm"), F.array_join("errors", ",").alias("errors"))


@check("""SELECT doc_id, strpos(t, 'forward') AS start FROM (SELECT doc_id, repeat('😀', CAST(doc_id % 40 AS INT)) || ' forward all' AS t FROM documents)""")
def word_start_in_characters(spark, sf):
    text = F.concat(F.repeat(F.lit("😀"), (F.col("doc_id") % 40).cast("int")), F.lit(" forward all"))
    return table(spark, sf, "documents").select("doc_id", word_start(text, F.lit("forward")).cast("bigint").alias("start"))
