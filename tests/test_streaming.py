import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.streaming import jobs, keyed
from wardline.streaming.run import run_available


class Feed:
    """A stream fed with one file per call; each run handles what has arrived since the last."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        os.makedirs(f"{self.folder}/in", exist_ok=True)

    def stream(self):
        return self.spark.readStream.schema(self.schema).json(f"{self.folder}/in/*").withColumn(
            "ts", F.col("ts").cast("timestamp"))

    def run(self, job, *batches):
        for data in batches:
            n = len(os.listdir(f"{self.folder}/in"))
            self.spark.createDataFrame(data, self.schema).coalesce(1).write.json(f"{self.folder}/in/{n:03d}")
            out = run_available(job(self.stream()), f"{self.folder}/out")
        return out


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path / "feed", schema)


def test_replies_and_silence(spark, feed):
    f = feed("session string, seq bigint, direction string, id string, ts string")
    at = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    one = [("s", 1, "request", "a", at(0)), ("s", 2, "request", "b", at(1)), ("s", 3, "request", None, at(2))]
    two = [("s", 4, "response", "a", at(4)), ("s", 5, "response", "b", at(9))]
    late = [("s", 6, "request", "z", at(600)), ("s", 7, "response", "y", at(600))]
    out = f.run(jobs.reply_matches_stream, one, two, late, [("s", 8, "request", "w", at(700)), ("s", 9, "response", "v", at(700))])
    got = {(r.seq, r.status) for r in out.collect()}
    assert {(1, "answered"), (2, "silent")} <= got and not any(s == 3 for s, _ in got)


def test_drift_against_the_stored_listing(spark, feed):
    schema = "server string, name string, description string, inputSchema string, annotations string"
    f = feed(f"{schema}, ts string")
    row = lambda name, text, server="s": (server, name, text, '{"a":1}', None, "2026-01-01 00:00:00")
    base = spark.createDataFrame([("s", "a", "x", '{"a":1}', None), ("s", "b", "y", '{"a":1}', None)], schema)
    job = lambda s: jobs.drift_stream(base, s)
    first = [row("a", "x"), row("b", "y!"), row("new", "")]
    later = [row("a", "x!"), row("b", "y"), row("a", "x", "without a base")]
    out = f.run(job, first, later)
    assert rows(out, "server", "tool_name") == [("s", "a"), ("s", "b"), ("s", "new")]


def test_lifecycle_state_lives_between_runs(spark, feed):
    f = feed("session string, seq bigint, direction string, method string, ts string")
    row = lambda seq, method, direction="request": ("s", seq, direction, method, "2026-01-01 00:00:00")
    job = lambda s: keyed.lifecycle_stream(s.withWatermark("ts", "1 hour"))
    out = f.run(job, [row(1, "tools/list"), row(2, "initialize")], [row(3, "tools/call"), row(4, "initialize")],
                [row(5, None, "closed"), row(6, "ping")])
    assert rows(out, "seq", "violation") == [
        (1, "tools_list_before_initialize"), (4, "second_initialize"), (6, "request_after_close")]


def test_a_pause_does_not_end_a_session(spark, feed):
    f = feed("session string, seq bigint, direction string, method string, ts string")
    row = lambda session, seq, method, hour: (session, seq, "request", method, f"2026-01-01 {hour:02d}:00:00")
    job = lambda s: keyed.lifecycle_stream(s.withWatermark("ts", "1 hour"))
    out = f.run(job, [row("s", 1, "initialize", 0)], [row("t", 1, "initialize", 10)], [row("t", 2, "ping", 11)],
                [row("s", 2, "tools/call", 12), row("s", 3, "initialize", 12)])
    assert rows(out, "session", "seq", "violation") == [("s", 3, "second_initialize")]


def test_a_session_is_walked_in_parts(spark, feed):
    f = feed("session string, seq bigint, direction string, method string, ts string")
    method = lambda seq: {20: "initialize", 40: "initialize"}.get(seq, "tools/call")
    log = [("s", seq, "request", method(seq), "2026-01-01 00:00:00") for seq in range(50)] + [("s", 45, "closed", None, "2026-01-01 00:00:00")]
    job = lambda s: keyed.lifecycle_stream(s.withWatermark("ts", "1 hour"))
    expected = [(k, "tools_call_before_initialize") for k in range(20)] + [(40, "second_initialize")] + [(k, "request_after_close") for k in range(46, 50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(rows(f.run(job, log[::-1]), "seq", "violation")) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_findings_come_once(spark, feed):
    f = feed("name string, description string, ts string")
    row = lambda name, second: (name, "you must, you must", f"2026-01-01 00:00:{second:02d}")
    job = lambda s: jobs.once_per_finding(jobs.scan_surface_stream(s))
    out = f.run(job, [row("a", 1), row("a", 2)], [row("a", 3), row("b", 4)])
    assert rows(out, "tool_name", "signal") == [("a", "imperative_override"), ("b", "imperative_override")]


def test_call_stream_against_a_static_baseline(spark, feed):
    f = feed("run_id string, step bigint, tool string, args string, ts string")
    base = spark.createDataFrame([("t", '{"a":1}')], "tool string, args string")
    row = lambda step, tool, args: ("r", step, tool, args, "2026-01-01 00:00:00")
    out = f.run(lambda s: jobs.analyze_call_stream(s, base),
                [row(0, "t", '{"a":1}')], [row(1, "t", '{"a":"/etc/passwd"}'), row(2, "u", "{}")])
    assert rows(out, "step", "signal") == [
        (1, "cross_tool_contamination"), (1, "runtime_credential_access"), (2, "unexpected_tool_sequence")]


def test_the_stream_of_pairs_is_compared_with_its_silent_rows(spark):
    from checks.registry import CHECKS

    sf = "/root/testdata/sf0.001"
    got = CHECKS["stream_pair_replies_and_silence"][0](spark, sf)
    batch = CHECKS["pair_replies"][0](spark, sf).where("status != 'no_reply_due'")
    keys = ("session", "seq", "status")
    assert set(rows(got, *keys)) == set(rows(batch, *keys))
    assert got.where("status = 'silent'").count() == batch.where("status = 'silent'").count() > 0


def test_replies_of_one_repeated_id_meet_within_stretches_of_time(spark, feed):
    f = feed("session string, seq bigint, direction string, id string, ts string")
    at = lambda s: f"2026-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    asked, answered = range(0, 200, 3), range(1, 200, 4)  # every place of a stretch of ten seconds
    log = [("s", s, "request", "a", at(s)) for s in asked] + [("s", s, "response", "a", at(s)) for s in answered]
    end = [("s", 900, kind, kind, at(9000)) for kind in ("request", "response")]
    out = f.run(jobs.reply_matches_stream, log, end)
    pairs = sorted((q, r) for q in asked for r in answered if 0 <= r - q <= 5)
    got = out.where("status = 'answered'").select("seq", F.unix_timestamp("reply_ts") - F.unix_timestamp(F.lit(at(0)))).collect()
    assert sorted(tuple(r) for r in got) == pairs
    plan = jobs.reply_matches_stream(f.stream())._jdf.queryExecution().analyzed().toString()
    assert "stretch" in plan[plan.index("Join"):].splitlines()[0]
