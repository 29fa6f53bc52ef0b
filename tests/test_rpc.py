import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.operators import rpc

OK_ERROR = '{"jsonrpc":"2.0","id":1,"error":{"code":-1}}'
OK_RESULT = '{"jsonrpc":"2.0","id":1,"result":null}'


@pytest.mark.parametrize("outcome,line,crashed,due,expected", [
    ("reply", OK_ERROR, False, True, "graceful"),
    ("reply", OK_RESULT, False, True, "accepted_invalid"),
    ("reply", '{"result":1}', False, True, "malformed"),
    ("reply", "[]", False, True, "malformed"),
    ("reply", "garbage", False, True, "malformed"),
    ("closed", None, True, True, "crash"),
    ("closed", None, False, True, "connection_closed"),
    ("silent", None, False, True, "timeout"),
    ("silent", None, False, False, "graceful"),
])
def test_reply_classes(spark, outcome, line, crashed, due, expected):
    df = spark.createDataFrame([(outcome, line, crashed, due)], "outcome string, line string, crashed boolean, expects_reply boolean")
    assert rpc.classify_replies(df).first()["reply_class"] == expected


def test_reply_findings(spark):
    classes = ["graceful", "connection_closed", "accepted_invalid", "malformed", "timeout", "crash"]
    df = spark.createDataFrame([(c, c, "p" * 130) for c in classes], "label string, reply_class string, probe string")
    got = {r.tool_name: (r.severity, len(r.matched_text)) for r in rpc.reply_findings(df).collect()}
    assert got == {"connection_closed": ("low", 121), "accepted_invalid": ("medium", 121), "malformed": ("medium", 121),
                   "timeout": ("high", 121), "crash": ("critical", 121)}


@pytest.mark.parametrize("raw,expected", [
    ('{"method":"ping","id":"q-7"}', ["missing_jsonrpc_field"]),
    ('{"id":31,"jsonrpc":"2.1","method":"ping"}', ["wrong_jsonrpc_version"]),
    ('{"method":"ping","jsonrpc":"2.0","id":["q",7]}', ["id_as_array"]),
    ('{"method":"ping","jsonrpc":"2.0","id":{}}', ["id_as_object"]),
    ('{"jsonrpc":"2.0","id":"q-8","params":[4]}', ["missing_method"]),
    ('{"jsonrpc":"2.0","id":"q-9","method":"weather/today"}', ["unknown_method"]),
    ("GET /index.html", ["not_json"]),
    ("{ }", ["empty_object"]),
    ('{"jsonrpc":"2.0","id":5,"method":"%s"}' % ("ping/" * 20_000), ["oversized_method_name"]),
    ('{"method":"weather/changed","jsonrpc":"2.0"}', ["unknown_notification"]),
    ('{"id":"q-10","method":"tools/call","jsonrpc":"2.0","params":{"name":"sum","arguments":{"x":2}}}', []),
])
def test_envelope_rules(spark, raw, expected):
    df = spark.createDataFrame([("s", 1, raw)], "session string, seq int, raw string")
    assert [r[0] for r in rows(rpc.envelope_violations(df), "violation")] == expected


def test_lifecycle(spark):
    log = [("s", 1, "request", "tools/call"), ("s", 2, "request", "initialize"), ("s", 3, "request", "tools/list"),
           ("s", 4, "request", "initialize"), ("s", 5, "closed", None), ("s", 6, "request", "ping"),
           ("u", 1, "request", "tools/list"), ("u", 2, "request", "ping")]
    df = spark.createDataFrame(log, "session string, seq bigint, direction string, method string")
    assert rows(rpc.lifecycle_violations(df), "session", "seq", "violation") == [
        ("s", 1, "tools_call_before_initialize"), ("s", 4, "second_initialize"), ("s", 6, "request_after_close"),
        ("u", 1, "tools_list_before_initialize"),
    ]


def test_pairing_agrees_with_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(1500):
        kind = rng.choice(["request", "response"])
        ident = None if kind == "request" and rng.random() < 0.1 else str(rng.randint(0, 2))
        data.append((rng.choice(["hot", "hot", "s1"]), i, kind, ident, rng.randint(0, 1_200_000) * 1000))
    df = spark.createDataFrame(data, "session string, seq bigint, direction string, id string, us bigint").withColumn(
        "ts", F.timestamp_micros("us"))
    got = {r.seq: (r.status, r.us) for r in rpc.pair_replies(df).withColumn("us", F.unix_micros("reply_ts")).collect()}
    expected = {}
    for session, seq, kind, ident, at in data:
        if kind == "request":
            replies = [u for s, _, k, j, u in data if k == "response" and (s, j) == (session, ident) and at <= u <= at + 5_000_000]
            first = min(replies, default=None)
            expected[seq] = ("no_reply_due" if ident is None else "silent" if first is None else "answered", first)
    assert got == expected
