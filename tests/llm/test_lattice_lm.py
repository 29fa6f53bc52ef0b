import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_words import words
from pyspark.sql import functions as F
from wardline.llm import lattice_lm

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cuts(word, voc, logs):
    """Log of the sum over all cuts, by trying every one."""
    place = {p: i for i, p in enumerate(voc.pieces)}

    def total(rest):
        return 1.0 if not rest else sum(math.exp(logs[place[rest[:k]]]) * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in place)

    return math.log(total(lattice_lm.MARK + word))


def test_forward_sums_all_cuts():
    voc = lattice_lm.vocabulary(PATH)
    logs = np.log(voc.weights / voc.weights.sum())
    some = [b"a", b"the", "né€".encode(), b"\xff\x00", b"abcab", b"thething"]
    got, _ = lattice_lm.forward(some, voc, logs)
    assert np.allclose(got, [cuts(w, voc, logs) for w in some])
    assert np.allclose(got, [lattice_lm.forward_long(w, voc, logs.tolist()) for w in some])


def test_expected_counts_are_the_derivative():
    voc = lattice_lm.vocabulary(PATH)
    logs = np.log(voc.weights / voc.weights.sum())
    some, times = [b"thesea", b"on"], np.array([2.0, 5.0])
    got = lattice_lm.expected(some, times, voc, logs)
    for piece in (b"the", b"s", b"on", lattice_lm.MARK + b"the"):
        i = voc.pieces.index(piece)
        moved = logs.copy()
        moved[i] += 1e-5
        slope = (lattice_lm.forward(some, voc, moved)[0] - lattice_lm.forward(some, voc, logs)[0]) / 1e-5
        assert abs(slope @ times - got[i]) < 1e-3


def test_expected_counts_of_long_words():
    voc = lattice_lm.vocabulary(PATH)
    logs = np.log(voc.weights / voc.weights.sum())
    for word in ("thesea" * 300).encode(), ("日本語のテキスト" * 40).encode(), b"a" * 700, b"the", b"\xff":
        true = lattice_lm.expected([word], np.ones(1), voc, logs)
        for step in (1, 7, 300, 1 << 14):
            got = np.zeros(len(true))
            for piece, n in lattice_lm.expected_long(word, voc, logs.tolist(), step).items():
                got[piece] += n
            assert np.allclose(got, true)


def test_long_words_are_fitted_over_their_lattices(spark):
    some = [(("thesea" * 30).encode(), 2), (b"other", 1)]
    counted = spark.createDataFrame([(bytearray(w), c, c) for w, c in some], "word binary, c long, n long")
    logs, end = lattice_lm.fit(counted, 1, PATH, rounds=1)
    voc = lattice_lm.vocabulary(PATH)
    first = np.log(voc.weights / (voc.weights.sum() + max(1.0, 0.01 * voc.weights.sum())))
    weights = 0.1 + lattice_lm.expected([w for w, _ in some], np.ones(2), voc, first)
    assert np.allclose(logs, np.log(weights / (weights.sum() + 0.1))) and abs(end - math.log(0.1 / (weights.sum() + 0.1))) < 1e-9


def base_scores(rows, train):
    own = {k: [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for k, t in rows}
    counts = Counter(w for k in train for w in own[k])
    n, v = sum(counts.values()), len(counts)
    return {k: (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for k, w in own.items()}


@pytest.mark.parametrize("head", [0, 50, 1 << 17])
def test_base_scores(table, head):
    draw = random.Random(2)
    rows = [(k, words(k, draw.choice([0, 3, 200]))) for k in range(60)] + [(60, None), (61, " The\tTHE  the x" * 3), (62, "y" * 500)]
    train = {k for k, _ in rows if k % 4}
    got = lattice_lm.score(table(rows), F.col("doc_id") % 4 != 0, PATH, head_words=head, rounds=1).collect()
    want = base_scores(rows, train)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_held_out_likelihood(table):
    rows = [(k, words(k, 150, 60)) for k in range(60)]
    train = F.col("doc_id") % 5 != 0
    fitted = {r.doc_id: r.score for r in lattice_lm.score(table(rows), train, PATH).collect()}
    unfitted = {r.doc_id: r.score for r in lattice_lm.score(table(rows), F.lit(False), PATH).collect()}
    assert all(fitted[k] > unfitted[k] for k in fitted if k % 5 == 0)


def test_probabilities_add_up():
    """Over one training word and all cuts: the words' own arcs, the rest for other words, and the end make 1."""
    total, ends, counts = 10, 2, [5, 3]
    kept = sum(c - lattice_lm.DISCOUNT for c in counts) / total
    assert math.isclose(kept + lattice_lm.DISCOUNT * len(counts) / total + ends / total, 1.0)


def test_odd_tables(table, odd_rows):
    train = F.col("doc_id") > 3
    got = lattice_lm.score(table(odd_rows), train, PATH, rounds=1).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lattice_lm.score(table([]), train, PATH).collect() == []
