from wardline.operators.scan import DESCRIPTION_PATTERNS, RESPONSE_PATTERNS, scan_needles
from wardline.operators.tfidf import default_model
from wardline.rules import mutations as M
from wardline.rules import signals as S


def test_table_sizes():
    assert len(DESCRIPTION_PATTERNS) == 188 and len(RESPONSE_PATTERNS) == 37
    assert len(S.SIGNALS) == 28
    assert len(default_model().idf) == 73
    assert sum(len(v) for v in M.STRING_PROBES.values()) == 60
    assert len(M.INTEGER_BOUNDARIES) == 22


def test_needles_are_folded_known_and_unique():
    for patterns in (DESCRIPTION_PATTERNS, RESPONSE_PATTERNS):
        needles = [p.needle for p in patterns]
        assert all(n and n == p.folded for n, p in zip(needles, patterns, strict=True))
        assert len(set(needles)) == len(needles)
        assert all(p.signal in S.SIGNAL_NAMES and p.severity in S.SEVERITIES for p in patterns)


def test_every_needle_is_found(spark):
    for patterns in (DESCRIPTION_PATTERNS, RESPONSE_PATTERNS):
        texts = [(p.needle, "x" + p.needle.encode().upper().decode() + "y") for p in patterns]
        df = spark.createDataFrame(texts, "name string, text string")
        got = {(r.tool_name, r.detail) for r in scan_needles(df, patterns=patterns).collect()}
        assert {(p.needle, p.explanation) for p in patterns} <= got


def test_rule_ids_follow_the_catalog_order():
    assert S.rule_id("imperative_override") == "WARD-001"
    assert S.rule_id("annotation_deception", "R") == "R-028"
