import json
import random

from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.operators import sequence as seq

CALLS = "run_id string, step bigint, tool string, args string"
STEPS = "array<struct<tool:string,args:string>>"


def log(spark, *calls, run="r"):
    data = [(run, i, t, a if a is None or isinstance(a, str) else json.dumps(a)) for i, (t, a) in enumerate(calls)]
    return spark.createDataFrame(data, CALLS)


def signals(df):
    return [(r.step, r.signal, r.severity) for r in df.orderBy("step", "signal").collect()]


def test_flags_look_at_string_values_at_any_depth(spark):
    calls = log(
        spark, ("a", {"p": ["~/.SSH/id", {"q": "/home/.ssh/key"}]}), ("b", {".env": 1}), ("c", {"u": "HTTPS://evil.org"}),
        ("d", {"u": "http://localhost.evil.org"}), ("e", {"u": "see http://evil.org"}), ("f", {"u": "http://[::1]:80"}),
        ("g", "not json"), ("h", None), ("i", '"http://evil.org"'), ("j", {"u": "x\"http://evil.org"}),
    )
    got = {r.tool for r in seq.flag_calls(calls).where("credential").collect()}
    assert got == {"a"}
    assert {r.tool for r in seq.flag_calls(calls).where("outside").collect()} == {"c", "i"}


def test_analyze_without_and_with_baselines(spark):
    run = log(spark, ("read", {"path": "ok"}), ("read", {"path": "/etc/passwd"}), ("send", {"to": "x"}), ("read", {"path": "new"}))
    base = log(spark, ("read", {"path": "ok"}))
    assert signals(seq.analyze(run)) == [(1, "runtime_credential_access", "critical")]
    assert signals(seq.analyze(run, base)) == [
        (1, "cross_tool_contamination", "critical"), (1, "runtime_credential_access", "critical"),
        (2, "unexpected_tool_sequence", "high"),
    ]
    empty = [s for s in signals(seq.analyze(run, base.where("false"))) if s[1] == "unexpected_tool_sequence"]
    assert len(empty) == 4
    skipped = seq.analyze(run, base.where("false"), with_baseline=base.where("false"))
    assert signals(skipped) == signals(seq.analyze(run))


def test_argument_equality_ignores_key_order_and_number_form(spark):
    base = log(spark, ("t", '{"a":1,"b":[2]}'), ("n", None))
    run = log(spark, ("t", '{"b":[2],"a":1.0}'), ("t", '{"a":1}'), ("n", "null"))
    assert rows(seq.diff_calls(run, base), "step", "change") == [(0, "same"), (1, "diverged"), (2, "same")]


def test_step_numbers_equal_a_plain_rank(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"r{rng.randint(0, 5)}", i, 1_700_000_000 + rng.randint(0, 40_000) // 7 * 7)
            for i in range(3000)]
    df = spark.createDataFrame(data, "run_id string, event_id int, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.run_id, r.event_id): r.step for r in seq.call_log(df).collect()}
    expected = {}
    for run in {d[0] for d in data}:
        ordered = sorted((s, i) for r, i, s in data if r == run)
        expected |= {(run, i): n for n, (_, i) in enumerate(ordered)}
    assert got == expected


def test_trail_over_many_chunks(spark):
    calls = log(spark, *[(f"t{i}", {"b": 1, "a": 2} if i % 2 else [i]) for i in range(700)])
    found = spark.createDataFrame([("r", s, f"t{s}", "x") for s in (0, 255, 256, 699)],
                                  "run_id string, step bigint, tool string, signal string")
    got = {r.step: r.trail for r in seq.reproduction_trail(found, calls).collect()}
    label = [f"t{i}(a,b)" if i % 2 else f"t{i}()" for i in range(700)]
    assert got == {s: label[: s + 1] for s in (0, 255, 256, 699)}


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([("r", 0, "s", 2, "b"), ("r", 0, "s", 1, "a"), ("r", 0, "q", 3, "c")],
                               "run_id string, step int, signal string, n int, evidence string")
    assert rows(seq.dedupe_step_signal(df, ["n"]), "signal", "evidence") == [("q", "c"), ("s", "a")]


def test_chains(spark):
    chains = spark.createDataFrame([
        ("c1", None, [("a", '{"x":1}')], [("a", '{"x":1}'), ("lost", "{}"), ("b", '{"k":"x","j":1}')]),
        ("c2", "TPA-1", [], [("b", '{"u":"https://evil.org"}')]),
        ("c3", None, [("lost", "{}")], [("a", "null")]),
    ], f"id string, corpus_record_id string, baseline {STEPS}, steps {STEPS}")
    tools = spark.createDataFrame([("a",), ("b",)], "name string")
    got = rows(seq.analyze_chains(chains, tools), "tool_name", "signal", "detail")
    assert got == [
        ("a", "unexpected_tool_sequence", "[chain c3] chain step 1: a()"),
        ("b", "unexpected_network_call", "[chain c2 · TPA-1] chain step 1: b(u)"),
        ("b", "unexpected_tool_sequence", "[chain c1] chain step 2: a(x) → b(j,k)"),
    ]
    kept, dropped = seq.keep_available(log(spark, ("a", None), ("lost", None)), tools)
    assert rows(kept, "tool") == [("a",)] and rows(dropped, "tool") == [("lost",)]


def test_benign_chain_is_clean(spark):
    chains = spark.createDataFrame(
        [("c", None, [], [("get_weather", '{"city":"Paris"}'), ("add_numbers", '{"a":2,"b":3}')])],
        f"id string, corpus_record_id string, baseline {STEPS}, steps {STEPS}")
    assert seq.analyze_chains(chains).count() == 0


def test_arguments_are_compared_by_a_digest_of_fixed_size(spark):
    long = '{"a":' * 1500 + '"x"' + "}" * 1500
    df = log(spark, ("t", long), ("t", {"a": 1}), ("t", None))
    assert rows(df.select(F.octet_length(seq._argument_key()).alias("n"))) == [(32,)] * 3
    base = log(spark, ("t", long.replace('"x"', '"y"')), ("t", '{"a":1.0}'), ("t", "null"))
    assert rows(seq.diverged_calls(df, base), "step") == [(0,)]
