"""Positions, ropes and trail reports on runs that hold most of all calls."""

import glob

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.functions.positions import with_positions
from wardline.operators import sequence as seq
from wardline.sources import sinks


def test_one_run_one_hour_all_rows(spark):
    """Places without a gap, and no partition of the sorted calls is far above the others."""
    df = spark.range(40_000).select(
        F.lit("r").alias("run_id"), F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 > 0, F.timestamp_seconds(F.col("id") % 1000)).alias("ts"))  # a third has no time
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with large tables
    try:
        placed = seq.call_log(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.event_id: r.step for r in placed.collect()}
    known = sorted(range(40_000), key=lambda i: (i % 3 > 0, i % 1000 if i % 3 else 0, i))
    assert [got[i] for i in known] == list(range(40_000))
    stored = spark.read.parquet(*placed.inputFiles())
    sizes = sorted(r[1] for r in stored.groupBy("_part").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_places_of_many_groups(spark):
    data = [(g, n) for g, size in ((None, 5), ("a", 1), ("b", 300)) for n in range(size)]
    df = spark.createDataFrame(data[::-1], "g string, n int")
    assert rows(with_positions(df, ["g"], ["n"], "at"), "g", "n", "at") == sorted([(g, n, n) for g, n in data], key=repr)
    assert with_positions(df.where("false"), ["g"], ["n"], "at").collect() == []


@pytest.mark.parametrize("fan", [2, 4096])
def test_equal_trails_have_equal_ropes(spark, fan, monkeypatch):
    monkeypatch.setattr(seq, "_ROPE", fan)
    tools = {"a": "xyzxyzxyz", "b": "xyzxyzxyw", "c": "yxzxyzxyz", None: "xyz"}
    calls = spark.createDataFrame([(r, k, t, "{}") for r, ts in tools.items() for k, t in enumerate(ts)], "run_id string, step bigint, tool string, args string")
    rope = {(r.run_id, r.step): (r.trail_calls, r.trail_hash) for r in seq.trail_rope(calls).collect()}
    assert len(rope) == 30
    for (r, k), one in rope.items():
        for (q, n), other in rope.items():
            assert (one == other) == (tools[r][:k + 1] == tools[q][:n + 1])


def test_every_call_is_a_finding(spark, tmp_path):
    """The report of a run whose 20 000 calls are all findings has two lines for each."""
    calls = spark.range(20_000).select(F.lit("r").alias("run_id"), F.col("id").alias("step"), F.lit("t").alias("tool"), F.lit('{"k":1}').alias("args"))
    found = seq.analyze(calls, calls.where("false"))
    sinks.write_trail_report(found, calls, f"{tmp_path}/report")
    lines = [line for name in sorted(glob.glob(f"{tmp_path}/report/part-*")) for line in open(name, encoding="utf-8").read().splitlines()]
    assert len(lines) == 40_001 and lines[0] == "run r"
    assert lines[1:5] == [
        "1. t(k)", "  high unexpected_tool_sequence: call to t has no counterpart in the baseline run, after calls 1-1",
        "2. t(k)", "  high unexpected_tool_sequence: call to t has no counterpart in the baseline run, after calls 1-2"]
    assert lines[-2] == "20000. t(k)"
    told = seq.to_findings(seq.rope_reference(found, seq.trail_rope(calls)))
    assert told.where(F.length("detail") > 80).count() == 0 and told.count() == 20_000
