from pyspark.sql import functions as F

from checks.inputs import INPUTS
from checks.registry import CHECKS
from wardline.functions import severity as sev
from wardline.functions import text as T


def one(spark, expr, **values):
    row = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], row).select(expr.alias("x")).first()["x"]


def test_ascii_lower_folds_only_a_to_z(spark):
    assert one(spark, T.ascii_lower(F.col("t")), t="ABC") == "abc"
    assert one(spark, T.ascii_lower(F.col("t")), t="AB K É Я") == "ab K É Я"


def test_words_keep_punctuation_tokens_as_empty(spark):
    got = one(spark, T.words(F.col("t")), t="  (send) -- it's\x0bok.\nété! ")
    assert got == ["send", "", "it's\x0bok", "t"]


def test_terms_drop_stop_words_and_short_runs(spark):
    assert one(spark, T.terms(F.col("t")), t="the a bcc-copy x of mail2") == ["bcc", "copy", "mail2"]


def test_snippet_cuts_at_forty_characters(spark):
    text = "a" * 50 + "NEEDLE" + "b" * 50
    got = one(spark, T.snippet(F.col("t"), F.lit(51), F.lit(6)), t=text)
    assert got == "…" + "a" * 40 + "NEEDLE" + "b" * 40 + "…"
    assert one(spark, T.snippet(F.col("t"), F.lit(1), F.lit(2)), t="hi there") == "hi there"
    assert one(spark, T.snippet(F.col("t"), F.lit(4), F.lit(3)), t="éé you") == "éé you"


def test_word_start_wants_white_space_before_and_falls_back_to_the_start(spark):
    at = lambda t: one(spark, T.word_start(F.col("t"), F.lit("relay")), t=t)
    assert at("a relayed relay, now") == 11
    assert at("relay it") == 1
    assert at("the (relay) only") == 1


def test_heads(spark):
    assert one(spark, T.head(F.col("t")), t="x" * 90) == "x" * 80
    assert one(spark, T.head_ellipsis(F.col("t")), t="x" * 121) == "x" * 120 + "…"
    assert one(spark, T.head_ellipsis(F.col("t")), t="x" * 120) == "x" * 120


def test_fingerprint_is_a_polynomial_of_the_bytes(spark):
    def expected(text):
        h = 0
        for b in text.encode():
            h = (h * 31 + b) % 2**32
        return f"t/s/{h:08x}"

    for text in ("matched snippet", "​", "…é" * 30):
        assert one(spark, T.fingerprint(F.lit("t"), F.lit("s"), F.col("t")), t=text) == expected(text)
    assert one(spark, T.fingerprint(F.lit("t"), F.lit("s"), F.col("t")), t="") == "t/s"


def test_scores_of_the_sequence_signals(spark):
    def severity(scope, conf, integ):
        return one(spark, sev.score_severity(sev.score(F.col("a"), F.col("b"), F.col("c"))), a=scope, b=conf, c=integ)

    assert severity("cross", "high", "high") == "critical"
    assert severity("cross", "high", "partial") == "critical"
    assert severity("cross", "partial", "partial") == "high"
    assert severity("session", "high", "none") == "medium"
    assert severity("session", "none", "none") == "low"
    assert severity("local", "none", "none") == "info"


def test_whole_documents_are_fingerprinted(spark, tmp_path):
    texts = ["", "a", "née 😀 " * 5000, "x" * 60 + "a", "x" * 60 + "b", None]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr(*INPUTS["surfaces"][1]).collect()

    def brute(name, text):
        h = 0
        for b in text.encode():
            h = (h * 31 + b) % 2**32
        return f"{name}/stealth_language/{h:08x}"

    expected = {r.doc_id: brute(r.name, r.text) if r.text is not None else None for r in held}
    got = {r.doc_id: r.fingerprint for r in CHECKS["fingerprint_whole_text"][0](spark, str(tmp_path)).collect()}
    assert got == expected and got[3] != got[4] and len(got) == 6
