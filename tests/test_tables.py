import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.operators import cases, corpus, evaluate, label, suppress
from wardline.operators.definitions import scan_tools
from wardline.operators.scan import scan_needles
from wardline.rules import labels as L
from wardline.rules import mutations as M


def schema(spark, properties=None, required=None):
    doc = {k: v for k, v in (("properties", properties), ("required", required)) if v is not None}
    return spark.createDataFrame([("t", json.dumps(doc))], "name string, inputSchema string")


def test_case_counts(spark):
    three = schema(spark, {f: {"type": "string"} for f in "abc"}, ["a"])
    assert cases.all_cases(three).count() == 2 + 3 * 70 + 1 + 1
    assert rows(cases.all_cases(schema(spark)), "label") == [("empty_args",), ("null_args",)]
    assert rows(cases.all_cases(schema(spark, {}, ["a"])), "label", "args") == [
        ("empty_args", "{}"), ("missing_required:a", "{}"), ("null_args", "null")]
    per_type = {"integer": 28, "number": 28, "boolean": 7, "array": 6, "object": 6, "null": 2, "string": 70}
    for kind, n in per_type.items():
        assert cases.boundary_cases(schema(spark, {"f": {"type": kind}})).count() == n


def test_cases_are_json_with_defaults(spark):
    df = schema(spark, {"a\"b": {"enum": ["x", 2]}, "n": {"type": "integer"}, "m": {"type": ["string", "null"]}}, ["n", "n"])
    got = {r.label: r.args for r in cases.all_cases(df).collect()}
    assert json.loads(got["a\"b:enum_valid:1"]) == {"a\"b": 2, "n": 0, "m": "fuzz_default"}
    assert json.loads(got["n:int:-129"]) == {"a\"b": "x", "n": -129, "m": "fuzz_default"}
    assert json.loads(got["missing_required:n"]) == {"a\"b": "x", "m": "fuzz_default"}
    assert json.loads(got["m:null_byte"])["m"] == "\0" and len(json.loads(got["m:long_64k"])["m"]) == 65536
    assert json.loads(got["extra_unknown_field"])[M.UNKNOWN_FIELD[0]] == M.UNKNOWN_FIELD[1]
    assert sum(k.startswith("missing_required") for k in got) == 1
    assert all(json.loads(v) is not False for v in got.values())


def labelled(spark):
    data = [("bad", True, "p1"), ("bad", True, "p1"), ("quiet", True, "p2"), ("flagged", False, None), ("clean", None, None)]
    return spark.createDataFrame(data, "name string, is_attack boolean, paradigm string")


def findings(spark, *names):
    return spark.createDataFrame([(n, "s", "high", 3, False) for n in names],
                                 "tool_name string, signal string, severity string, severity_rank int, suppressed boolean")


def test_benchmark_goes_by_name_and_counts_rows(spark):
    r = evaluate.benchmark_report(labelled(spark), findings(spark, "bad", "bad", "flagged")).first()
    assert (r.tools_total, r.tp, r.fp, r.fn, r.tn) == (5, 2, 1, 1, 1)
    assert (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) == (0.667, 0.667, 0.667)
    none = evaluate.benchmark_report(labelled(spark).where("false"), findings(spark)).first()
    assert (none.tools_total, none.precision, none.recall, none.f1) == (0, 0.0, 0.0, 0.0)


def test_rates_gates_and_totals(spark):
    f = findings(spark, "bad", "flagged")
    assert rows(evaluate.rate_by_paradigm(labelled(spark), f))[:1] == [("p1", 2, 2, 100.0)]
    assert evaluate.rate_by_risk(labelled(spark).withColumn("risk_category", F.col("paradigm")), f).first()[0] in ("Unknown", "p1")
    assert tuple(evaluate.false_positive_rate(labelled(spark), f).first()) == (2, 1, 0.5)
    assert evaluate.gate(f).first()["blocking"] is True
    assert evaluate.gate(f.withColumn("suppressed", F.lit(True))).first()["blocking"] is False
    assert evaluate.gate(f.where("false")).first()["blocking"] is False
    report = evaluate.benchmark_report(labelled(spark).where("name = 'bad'"), f)
    assert evaluate.regression_gate(report).first()["passed"] is True


def test_suppressions(spark):
    entries = spark.createDataFrame([("bad", "s", "known"), ("fixed", "s", "old")], "tool string, signal string, reason string")
    marked = suppress.apply_suppressions(findings(spark, "bad", "flagged"), entries)
    assert rows(marked, "tool_name", "suppressed") == [("bad", True), ("flagged", False)]
    assert rows(suppress.stale_suppressions(entries, marked), "tool") == [("fixed",)]
    new = spark.createDataFrame([("bad", "s", "again"), ("bad", "t", "new")], entries.schema)
    both, rejected = suppress.add_suppressions(entries, new)
    assert both.count() == 3 and rows(rejected, "reason") == [("again",)]


def test_corpus_rules(spark):
    with pytest.raises(ValueError):
        corpus.filter_category(labelled(spark), "nope")
    with pytest.raises(ValueError):
        corpus.filter_min_severity(labelled(spark), "nope")
    df = spark.createDataFrame([("REC-1.a", "You must", 1), ("REC-2", "You must", None), ("REC-3", None, 2)],
                               "id string, payload string, paradigm int")
    got = rows(corpus.corpus_selfscan(df), "tool_name", "signal", "detail")
    assert [g[:2] for g in got] == [("peer_rec_1_a", "imperative_override"), ("peer_rec_1_a", "unexpected_tool_sequence"),
                                    ("peer_rec_3", "unexpected_tool_sequence")]
    assert got[2][2] == "[peer-inject: REC-3] chain step 1: peer_rec_3()"


def test_heuristics(spark):
    texts = ["when using search, do it", "you must first call setup", "Nothing here", "WHEN the user asks about_it now",
             "before calling `x`, wait", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in rows(df.select("i", label.paradigm_heuristic(F.col("t")).alias("p")))]
    assert got == ["argument-hijacking", "fake-enabling-prerequisite", "unrelated-prerequisite", "argument-hijacking",
                   "fake-enabling-prerequisite", "unrelated-prerequisite", "unrelated-prerequisite"]
    texts = ["BCC me", "the api_key", "rm /etc/shadow", "Eval(", "pay the invoice", "outage", "user data", "tamper", "instruction", "fake", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in rows(df.select("i", label.risk_heuristic(F.col("t")).alias("p"))) if r[0] < 11]
    order = [r[1] for r in sorted(df.select("i", label.risk_heuristic(F.col("t")).alias("p")).collect())]
    assert order == [c for c, _ in L.RISK_PATTERNS] + [None] and len(got) == 11


def test_upstream_shapes(spark):
    docs = [
        ('[{"name":"a","template":"Template-1"}]',),
        ('{"items":[{"name":"b","risk":"Privacy Leakage"}],"data":"x"}',),
        ('{"argument-hijacking":[{"name":"c"}]}',),
        ('{"2":[{"name":"d","type":"3"}],"zzz":[{"name":"e"}]}',),
        ('{"code_injection":{"1":[{"name":"f"}]},"Financial Loss":{"odd":[{"name":"g","harm_type":"mine"}]}}',),
        ('{"x":[]}',), ("null",),
    ]
    df = spark.createDataFrame(docs, "doc string")
    got = {r.name: (r.paradigm, r.risk_category) for r in label.label_upstream(df).collect()}
    t1, t2, t3 = L.PARADIGMS
    assert got == {"a": (t1, None), "b": (t1, "Privacy Leakage"), "c": (t3, None), "d": (t3, None), "e": (t1, None),
                   "f": (t1, "Code Injection"), "g": (t1, "mine")}
    assert label.unrecognised_upstream(df).count() == 2 and t2


def test_fields_fall_through_when_empty(spark):
    df = spark.createDataFrame([('[{"name":"","tool_name":0,"id":"z","description":null,"desc":"d","inputSchema":{}}]',)], "doc string")
    r = label.label_upstream(df).first()
    assert (r.name, r.description, r.inputSchema) == ("z", "d", L.DEFAULT_SCHEMA)


def test_a_table_of_own_patterns(spark):
    from wardline.operators.patterns import scan_pattern_table

    patterns = spark.createDataFrame(
        [("Needle", "stealth_language", "high", ["R-1"]), ("ed", "session_persistence", "low", []), ("x", "value_substitution", "info", []),
         ("needle work", "identity_impersonation", "medium", [])],
        "needle string, signal string, severity string, corpus_refs array<string>")
    texts = spark.createDataFrame([(1, "a", "A NEEDLE worked"), (2, "b", "nothing"), (3, "c", None), (4, "d", "x")],
                                  "id int, name string, text string")
    small = rows(scan_pattern_table(texts, patterns, key="id"), "id", "signal", "matched_text", "detail")
    assert [s[:2] for s in small] == [
        (1, "identity_impersonation"), (1, "session_persistence"), (1, "stealth_language"), (4, "value_substitution")]


def test_findings_schema_is_the_same_everywhere(spark):
    from wardline.functions.findings import FINDING_COLUMNS

    tools = spark.createDataFrame([("t", "you must", None, None)], "name string, description string, inputSchema string, annotations string")
    assert scan_tools(tools).columns == FINDING_COLUMNS
    assert scan_needles(tools, text="description").columns == FINDING_COLUMNS


def test_label_patterns_run_only_on_texts_that_hold_their_literals(spark):
    import random
    import re

    from wardline.operators.label import literal_parts

    assert literal_parts(r"api[_\s]?key") == (["api", "key"], False) and literal_parts(r"eval\(") == (["eval("], True)
    assert literal_parts(r"\.ssh") == ([".ssh"], True) and literal_parts("a|b") == literal_parts("(a)") == ([], False)
    words = [w for _, ps in L.RISK_PATTERNS for p in ps for w in literal_parts(p)[0]]
    assert all(literal_parts(p)[0] for _, ps in L.RISK_PATTERNS for p in ps)
    draw = random.Random(3)
    texts = ["".join(draw.choice([*words, " ", "\n", "X", ".", "_"]) for _ in range(draw.randrange(7))) for _ in range(1500)]

    def by_hand(text):
        low = text.lower()
        return next((c for c, ps in L.RISK_PATTERNS if any(re.search(p, low) for p in ps)), None)

    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "k int, text string")
    got = {r.k: r.risk for r in df.select("k", label.risk_heuristic(F.col("text")).alias("risk")).collect()}
    assert got == {k: None if t is None else by_hand(t) for k, t in enumerate([*texts, None, ""])}
