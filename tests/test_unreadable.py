"""JSON that is broken, too deep or repeats a key, characters outside the BMP, null keys and hot ids."""

import re
import time

from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.functions import jsontext as J
from wardline.functions.text import word_start
from wardline.operators import definitions, drift, label, rpc
from wardline.operators import sequence as seq

DEEP = '{"a":' * 1500 + '"/etc/passwd"' + "}" * 1500
REPEATED = '{"a":1,"a":"/etc/passwd"}'
CUT = '{"a":"x","b":"/etc/pass' + 'wd'
HIDDEN = '{"a":1,"a":"\\u002fetc\\u002fpasswd"}'


def test_unreadable_arguments_are_flagged(spark):
    texts = [(DEEP,), (REPEATED,), (CUT,), (HIDDEN,), ('{"a":1,"a":"https://evil.example"}',), ('{"a":1,"a":2}',), (None,)]
    df = seq.flag_calls(spark.createDataFrame(texts, "args string"))
    assert [(r.credential, r.outside) for r in df.collect()] == [
        (True, False), (True, False), (True, False), (True, False), (False, True), (False, False), (False, False)
    ]


def test_unreadable_texts_compare_as_they_stand(spark):
    schema = "run_id string, step long, tool string, args string"
    calls = spark.createDataFrame([("r", 0, "t", '{"a":1,"a":2}'), ("r", 1, "t", '{"a":1,"a":3}')], schema)
    base = spark.createDataFrame([("r", 0, "t", '{"a":1,"a":2}')], schema)
    assert rows(seq.diff_calls(calls, base), "step", "change") == [(0, "same"), (1, "diverged")]


def test_drift_and_hints_see_unreadable_json(spark):
    schema = "name string, description string, inputSchema string, annotations string"
    old = spark.createDataFrame([("t", "d", '{"a":1,"a":"x"}', None), ("u", "d", "{}", None)], schema)
    new = spark.createDataFrame([("t", "d", '{"a":1,"a":"y"}', None), ("u", "d", "{ }", None)], schema)
    assert rows(drift.definition_drift(old, new), "tool_name") == [("t",)]
    hints = '{"readOnlyHint":false,"readOnlyHint":true}'
    df = spark.createDataFrame([("t", "deletes the file", None, hints), ("u", "deletes the file", None, hints[::-1])], schema)
    assert rows(definitions.scan_annotations(df), "tool_name", "signal") == [("t", "annotation_deception")]
    deep = '{"p":' * 3000 + '{"description":"You must first do it"}' + "}" * 3000
    df = spark.createDataFrame([("t", "d", deep, None)], schema)
    assert definitions.scan_schema_text(df).count() > 0
    bad = J.unreadable_json(df.unionByName(old), ["inputSchema", "annotations"])
    assert rows(bad, "name", "column") == [("t", "inputSchema"), ("t", "inputSchema")]


def test_replies_with_repeated_keys(spark):
    lines = ['{"jsonrpc":"2.0","error":1,"error":2}', '{"jsonrpc":"2.0","jsonrpc":"2.0","result":1}', "{"]
    df = spark.createDataFrame([("reply", x, False, True) for x in lines], "outcome string, line string, crashed boolean, expects_reply boolean")
    assert [r.reply_class for r in rpc.classify_replies(df).collect()] == ["graceful", "accepted_invalid", "malformed"]


def test_positions_count_characters(spark):
    df = spark.createDataFrame([("😀" * 30 + " forward it",), ("forward",), ("none",)], "t string")
    assert [r[0] for r in df.select(word_start(F.col("t"), F.lit("forward"))).collect()] == [32, 1, 1]


def test_null_keys_stay(spark):
    calls = spark.createDataFrame([(None, "2024-01-01 00:00:00", 1), (None, None, 2), ("a", "2024-01-01 00:00:00", 3)], "run_id string, ts string, event_id long")
    got = seq.call_log(calls.withColumn("ts", F.col("ts").cast("timestamp")))
    assert rows(got, "event_id", "step") == [(1, 1), (2, 0), (3, 0)]
    log = spark.createDataFrame([(None, 1, "request", "tools/call"), (None, 2, "request", "initialize")], "session string, seq long, direction string, method string")
    assert rows(rpc.lifecycle_violations(log), "seq", "violation") == [(1, "tools_call_before_initialize")]


def test_one_id_many_times(spark):
    n = 80_000
    log = spark.range(n).select(
        F.lit("s").alias("session"), F.col("id").alias("seq"), F.lit("1").alias("rid"),
        (F.lit("2024-01-01 00:00:10").cast("timestamp") + F.expr("make_dt_interval(0,0,0, id * 0.00005)")).alias("ts"),
        F.when(F.col("id") % 2 == 0, "request").otherwise("response").alias("direction"),
    ).withColumnRenamed("rid", "id")
    start = time.time()
    got = rpc.pair_replies(log).agg(F.count("*"), F.count("reply_ts")).first()
    assert tuple(got) == (n // 2, n // 2) and time.time() - start < 30


def test_flags_of_unreadable_texts_look_for_markers_without_patterns(spark):
    texts = ['{"a":1,"a":"\\/etc\\/passwd"}', '{"a":"x","b":"/ETC/passwd', '{"a":1,"a":"HTTPS://evil.org"}', '{"a":1,"a":"https://localhost"}', '{"a":1,"a":"h\\u0074tp://e.org"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, args string")
    assert rows(seq.flag_calls(df), "i", "credential", "outside") == [
        (0, True, False), (1, True, False), (2, False, True), (3, False, False), (4, False, True)]
    plan = seq.flag_calls(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and not re.search(r"args#\d+,? RLIKE \(\?i\)/|RLIKE\(args#\d+, \(\?i\)/", plan)


def parses(df):
    """How often the plan reads JSON text."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson(")


def test_upstream_documents_are_read_once(spark):
    docs = ["[1]", '{"Template-2":[]}', '{"Credential Leakage":{}}', '{"items":[]}', '{"other":1}', "broken {", None, '{"a":1,"a":2}', "3"]
    found = label.unrecognised_upstream(spark.createDataFrame([(d,) for d in docs], "doc string"))
    assert sorted((r.doc for r in found.collect()), key=str) == sorted(docs[4:], key=str)
    assert parses(found) == 1


def test_hints_are_read_once(spark):
    df = spark.createDataFrame([("t", "deletes the file", None, '{"readOnlyHint":true,"destructiveHint":false}')], "name string, description string, inputSchema string, annotations string")
    found = definitions.scan_annotations(df)
    assert found.count() == 2 and parses(found) <= 2  # once in a filter, once in the rows


ODD = [
    *('{"a":' * n + "1" + "}" * n for n in (999, 1000, 1001)), '{"a":' + "[" * 999 + "]" * 999 + "}", '{"a":' + "[" * 1000 + "]" * 1000 + "}",
    '{"a":1} x', '{"a":1}{"a":2}', "{}", "[1]", '{"a":{"b":1,"b":2}}', "{'a':1}", '{"a":01}', '{"a":1e999}', '{"a":NaN}', '{"\\u0061":1,"a":2}',
    '{"a":"\x01"}', '﻿{"a":1}', '{"a":' + "9" * 1001 + "}", '{"' + "k" * 60000 + '":1}', '{"a":1,}', '{"":1,"":2}', '{"":1}', "{a:1}", ' {"a":1', "",
    '{"a":null,"b":[{},[]]}', '{"a":1,/*c*/"b":2}', '{"a":1.0,"b":1}', '{"a":[1,2}', '{"a":tru}', '{"a":"\\x"}', '{"a":"\\ud800"}', CUT, DEEP, HIDDEN, None,
]


def test_the_look_before_parsing_refuses_only_what_the_parser_does(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "d string")
    plain = F.to_json(F.try_parse_json("d"))
    got = df.select("d", J.canonical_json(F.col("d")).alias("c"), plain.alias("p"), J.unreadable(F.col("d")).alias("u")).collect()
    assert [r.c for r in got] == [r.p for r in got]
    assert [r.u for r in got] == [r.d is not None and r.p is None for r in got]


def test_unreadable_documents_cost_no_exceptions(spark):
    df = spark.range(4000).select(F.concat(F.lit('{"a":' * 1500), "id", F.lit("}" * 1500)).alias("d")).repartition(2).cache()

    def seconds(column):
        start = time.perf_counter()
        df.select(F.bit_xor(F.xxhash64(column))).collect()
        return time.perf_counter() - start

    df.count()
    plain, own = (min(seconds(c) for _ in range(3)) for c in (F.to_json(F.try_parse_json("d")), J.canonical_json(F.col("d"))))
    assert own < plain / 2
