"""Streams with state by key against their batch forms, on logs that arrive in several parts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_streaming import Feed
from wardline.operators import drift, rpc
from wardline.streaming import keyed

LOG = "session string, seq bigint, direction string, id string, ts string"


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path / "feed", schema)


def at(second):
    return f"2026-01-01 {second // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}"


def test_nearest_replies_are_those_of_the_batch(spark, feed):
    """Ids that repeat, replies that several requests wait for, replies without request, pauses, bucket edges."""
    draw, parts, seq = random.Random(1), [], 0
    for start in (0, 594, 1195, 7000):  # the second and third part lie across an edge of ten minutes
        part = []
        for _ in range(60):
            seq += 1
            kind = draw.choice(["request", "response"])
            part.append((draw.choice(["s", "t", None]), seq, kind, draw.choice(["a", "b", "a", None]), at(start + draw.randrange(12))))
        parts.append(part)
    parts.append([("end", 1, kind, "x", at(20_000)) for kind in ("request", "response")])
    got = feed(LOG).run(keyed.pair_reply_stream, *parts).where("session IS DISTINCT FROM 'end'")
    log = spark.createDataFrame([r for p in parts[:-1] for r in p], LOG).withColumn("ts", F.col("ts").cast("timestamp"))
    want = rpc.pair_replies(log)
    columns = ["session", "seq", "id", "ts", "reply_ts", "status"]
    assert rows(got, *columns) == rows(want, *columns)
    assert {r.status for r in got.select("status").distinct().collect()} == {"answered", "silent", "no_reply_due"}


def test_a_reply_that_comes_before_its_request_in_another_part(feed):
    f = feed(LOG)
    job = lambda log: keyed.pair_reply_stream(log, late="1 minute")
    out = f.run(job, [("s", 2, "response", "a", at(4))], [("s", 1, "request", "a", at(1)), ("s", 3, "request", "a", at(5))],
                [("end", 9, "request", "x", at(600))])
    assert rows(out.where("session = 's'"), "seq", "status") == [(1, "answered"), (3, "silent")]


LISTINGS = "server string, name string, description string, inputSchema string, annotations string, ts string"


def listing(server, name, text, second, schema='{"a":1,"b":2}'):
    return (server, name, text, schema, None, at(second))


def test_each_change_is_found(spark, feed):
    """There and back again is two changes; key order is none; a name without a base is one only where its server has a base."""
    base = spark.createDataFrame([listing("s", "t", "x", 0), listing("s", "u", "old", 0), listing("s", "u", "x", 1)], LISTINGS).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    parts = [
        [listing("s", "t", "y", 12), listing("s", "t", "x", 14), listing("s", "t", "x", 15, '{"b":2,"a":1}'), listing("s", "u", "x", 11)],
        [listing("s", "t", "x", 20), listing("s", "new", "x", 21), listing("r", "t", "x", 22)],
        [listing("s", "t", "z", 100_00), listing("r", "t", "y", 100_01), listing("s", "new", "x", 100_02), (None, "t", "x", None, None, at(100_03))],
        [listing("r", "t", "x", 200_00), (None, "t", "y", None, None, at(200_01))],
    ]
    got = feed(LISTINGS).run(lambda s: keyed.change_stream(s, base), *parts)
    every = spark.createDataFrame([r for p in parts for r in p], LISTINGS).withColumn("ts", F.col("ts").cast("timestamp"))
    for bucket in (1, 86_400):
        want = drift.definition_changes(every, base, bucket_seconds=bucket)
        assert got.columns == want.columns
        assert rows(got) == rows(want)
    found = [(r.server, r.tool_name, r.ts.strftime("%H:%M:%S")) for r in got.orderBy("ts").collect()]
    assert found == [
        ("s", "t", "00:00:12"), ("s", "t", "00:00:14"), ("s", "new", "00:00:21"), ("s", "t", "02:46:40"), ("r", "t", "02:46:41"),
        ("r", "t", "05:33:20"), (None, "t", "05:33:21")]


def test_changes_without_a_base(spark, feed):
    parts = [[listing("s", "t", "x", 0)], [listing("s", "t", "y", 5), listing("s", "u", "y", 5)]]
    got = feed(LISTINGS).run(keyed.change_stream, *parts)
    every = spark.createDataFrame([r for p in parts for r in p], LISTINGS).withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(got) == rows(drift.definition_changes(every)) and rows(got, "tool_name") == [("t",)]


def test_rows_that_come_late_count_with_the_state_so_far(feed):
    f = feed("session string, seq bigint, direction string, method string, ts string")
    row = lambda seq, method, direction="request": ("s", seq, direction, method, at(0))
    out = f.run(keyed.lifecycle_stream, [row(5, "initialize"), row(6, "tools/call")], [row(2, "tools/list"), row(7, "initialize")],
                [row(9, None, "closed")], [row(8, "ping"), row(None, "tools/call")])
    assert rows(out, "seq", "violation") == sorted(
        [(7, "second_initialize"), (8, "request_after_close"), (None, "request_after_close")], key=repr)


def test_order_of_numbers_beyond_doubles_and_of_parts_in_several_batches(spark, feed):
    """Numbers that a double cannot tell apart, and sessions whose rows come in more than one Arrow batch."""
    n = 1 << 53
    row = lambda session, seq, method, second=0: (session, seq, "request", method, at(second) if seq != 3 else None)
    big = [row("s", n, "initialize"), row("s", n + 1, "initialize"), row("s", n, "tools/call")]
    long = [row(None, k, "initialize" if k % 7 == 6 else "tools/list", k) for k in range(25)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = feed("session string, seq bigint, direction string, method string, ts string").run(keyed.lifecycle_stream, big + long)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(out.where("session = 's'"), "seq", "violation") == [(n + 1, "second_initialize")]
    got = out.where("session IS NULL").selectExpr("seq", "violation", "second(ts) AS at")
    want = [(k, "tools_list_before_initialize", None if k == 3 else k) for k in range(6)] + [(k, "second_initialize", k) for k in (13, 20)]
    assert rows(got, "seq", "violation", "at") == sorted(want, key=repr)


def test_a_session_may_be_forgotten(feed):
    f = feed("session string, seq bigint, direction string, method string, ts string")
    row = lambda session, seq, method, second: (session, seq, "request", method, at(second))
    job = lambda log: keyed.lifecycle_stream(log, quiet="1 hour")
    out = f.run(job, [row("s", 1, "initialize", 0), row("t", 1, "initialize", 0)], [row("t", 2, "ping", 3000)], [row("u", 1, "ping", 5000)],
                [row("s", 2, "tools/call", 5001), row("t", 3, "tools/call", 5001)])
    assert rows(out, "session", "seq", "violation") == [("s", 2, "tools_call_before_initialize")]
