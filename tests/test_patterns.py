"""Scans with pattern tables of any size against a search for each pattern in each text."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline.functions import text as T
from wardline.operators import patterns

SCHEMA = "needle string, signal string, severity string, corpus_refs array<string>"


def by_hand(texts, needles):
    fold = lambda s: s.encode().lower().decode()
    return sorted((k, f"s: '{n}'", fold(t).index(fold(n)) + 1) for k, _, t in texts for n in needles if t and n and fold(n) in fold(t))


@pytest.mark.parametrize("block", [64, patterns.BLOCK])
@pytest.mark.parametrize("bits", [8, patterns.BITS])
def test_random_tables(spark, block, bits, monkeypatch):
    """Needles of all lengths, shorter and longer than a gram or a block; bit tables that are full only cost time."""
    monkeypatch.setattr(patterns, "BLOCK", block)
    monkeypatch.setattr(patterns, "BITS", bits)
    draw = random.Random(block + bits)
    make = lambda n, signs: "".join(draw.choice(signs) for _ in range(n))
    texts = [(k, "t", make(draw.randrange(300), "abA é漢😀\n")) for k in range(40)] + [(90, "t", None), (91, "t", ""), (92, "t", "ab" * 500)]
    needles = {make(draw.randrange(1, 12), "abA é漢😀") for _ in range(300)} | {t[i:i + 130] for _, _, t in texts[:20] for i in (0, 7)} | {"ab" * 200}
    needles -= {""}
    table = spark.createDataFrame([(n, "s", "low", None) for n in [*needles, None, ""]], SCHEMA)
    found = patterns.scan_pattern_table(spark.createDataFrame(texts, "id int, name string, text string"), table, "id")
    starts = {(k, d): s for k, d, s in by_hand(texts, needles)}
    assert rows(found, "id", "detail") == sorted(starts, key=repr) and len(starts) > 300
    whole = dict((k, t) for k, _, t in texts)
    for r in found.collect():
        assert r.matched_text.strip("…") in whole[r.id]


def test_first_places():
    look = patterns._stretches(np.full(1 << (patterns.BITS - 3), 255, np.uint8), np.full(1 << (patterns.BITS - 3), 255, np.uint8), [2, 7])
    text = b"abcabcabcabc"
    assert look(text) == {text[i:i + n]: text.index(text[i:i + n]) for n in (2, 7) for i in range(len(text) - n + 1)}


def test_equal_needles_and_no_patterns(spark):
    texts = spark.createDataFrame([(1, "a", "A NEEDLE worked")], "id int, name string, text string")
    twice = spark.createDataFrame([("Needle", "a", "high", ["R-1"]), ("nEEDLE", "b", "low", []), ("needle", "b", "low", [])], SCHEMA)
    assert rows(patterns.scan_pattern_table(texts, twice, "id"), "signal", "corpus_refs", "matched_text") == [
        ("a", ["R-1"], "A NEEDLE worked"), ("b", [], "A NEEDLE worked"), ("b", [], "A NEEDLE worked")]
    assert patterns.scan_pattern_table(texts, twice.where("false"), "id").collect() == []


def test_table_of_wholes_grows_with_the_needles(spark, monkeypatch):
    """Texts hand on little but true needles, however many there are and however many lengths they have."""
    monkeypatch.setattr(patterns, "BITS", 10)
    draw = random.Random(7)
    text = "".join(draw.choice("abcd ") for _ in range(20_000))
    needles = {"".join(draw.choice("abcd ") for _ in range(draw.randrange(7, 60))) for _ in range(3_000)} | {text[i:i + 24] for i in range(0, 5_000, 97)}
    table = spark.createDataFrame([(n,) for n in needles], "_needle string")
    *tables, lengths = patterns._bit_tables(table)
    found = {n.decode() for n in patterns._stretches(*tables, lengths)(text.encode())}
    true = {n for n in needles if n in text}
    assert true <= found and len(found) < len(text) / 10  # of a million stretches of these lengths
    assert [len(t) for t in tables] == [1 << 7, 1 << 13]


def test_snippets_are_those_of_text(spark):
    """Snippets that the search cuts out are those of the Column function, also beside characters of several bytes."""
    texts = [(k, "t", "é漢😀 " * k + "Needle" + "😀x" * m) for k in (0, 3, 10, 11, 40) for m in (0, 19, 20, 21, 60)]
    df = spark.createDataFrame(texts, "id int, name string, text string")
    got = patterns.scan_pattern_table(df, spark.createDataFrame([("needle", "s", "low", None)], SCHEMA), "id").select("matched_text")
    want = df.select(T.snippet(F.col("text"), F.expr("instr(text, 'Needle')"), F.lit(6)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fragments_are_cut_in_one_pass(spark, tmp_path):
    """Pieces of long texts are not cut by reading the text from its start for each."""
    from checks.text_checks import CHECKS

    text = "".join(random.Random(3).choice("abcdefgé漢😀\n") for _ in range(400_000))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    begun = time.monotonic()
    found = CHECKS["scan_pattern_table_of_fragments"][0](spark, str(tmp_path)).select("detail").collect()
    assert {r[0] for r in found} == {f"fragment: '{text[i:i + 24]}'" for i in range(0, len(text) - 23, 97)}
    assert time.monotonic() - begun < 30


@pytest.mark.parametrize("bits", [8, patterns.BITS])
def test_dense_tables_settle_finds_in_place(spark, bits, monkeypatch):
    """Texts that hold many needles get the rows of the join without a join of snippets, even if every stretch looks like a needle."""
    monkeypatch.setattr(patterns, "BITS", bits)
    monkeypatch.setattr(patterns, "BLOCK", 64)
    draw = random.Random(bits)
    make = lambda n, signs: "".join(draw.choice(signs) for _ in range(n))
    texts = [(k, "t", make(draw.randrange(300), "abA é漢😀\n")) for k in range(40)] + [(90, "t", None), (91, "t", ""), (92, "t", "ab" * 500)]
    fold = lambda s: s.encode().lower().decode()
    needles = {fold(t[i:i + n]) for _, _, t in texts[:20] for n in (3, 24, 31, 90) for i in range(0, len(t) - n, 17)} | {"ab" * 40, "zzz"}
    df = spark.createDataFrame(texts, "id int, name string, text string").repartition(3)
    table = spark.createDataFrame([(n, "s", "low", None) for n in needles], SCHEMA)
    want = patterns.scan_pattern_table(df, table, "id")
    got = patterns.scan_pattern_table(df, table, "id", dense=True)
    assert "Join" in plan(want) and "Join" not in plan(got) and got.dtypes == want.dtypes
    assert rows(got) == rows(want)
    assert rows(got, "id", "detail") == sorted([(k, d) for k, d, _ in by_hand(texts, needles)], key=repr)


def test_dense_tables_that_differ_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a", "A NEEDLE worked")], "id int, name string, text string")
    scan = lambda *rules: patterns.scan_pattern_table(texts, spark.createDataFrame(rules, SCHEMA), "id", dense=True)
    found = lambda df: rows(df, "signal", "detail")
    one, other = ("needle", "a", "high", ["R-1"]), ("worked", "a", "high", ["R-1"])
    assert "Join" not in plan(scan(one, other))
    for rules in ([one, one], [one, ("worked", "b", "high", ["R-1"])], [one, ("Worked", "a", "high", ["R-1"])], [one, ("worked", "a", "high", None)]):
        assert "Join" in plan(scan(*rules)) and found(scan(*rules)) == sorted((s, f"{s}: '{n}'") for n, s, _, _ in rules)
    assert patterns.scan_pattern_table(texts, spark.createDataFrame([one], SCHEMA).where("false"), "id", dense=True).collect() == []
    monkeypatch.setattr(patterns, "MOST_DOUBTFUL", -1)
    assert "Join" in plan(scan(one, other)) and found(scan(one, other)) == [("a", "a: 'needle'"), ("a", "a: 'worked'")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
