import numpy as np
import pytest

from llm_words import words
from wardline.llm import nbsvm


def corpus(n):
    rows, labels = [], []
    for k in range(n):
        good = k % 4 != 0
        text = words(k, 60)
        rows.append((k, text.capitalize() + "." if good else text.replace(" ", "*** ") + "&&&"))
        labels.append((k, int(good)))
    return rows, labels


def test_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    weights, bias = nbsvm.descend(rows, np.array([1.0, 1.0, -1.0, -1.0]), np.array([1.0, -1.0, 0.1, 0.1]), 1.0, 50)
    ratios = np.array([1.0, -1.0, 0.1, 0.1])
    margins = [bias + weights[r] @ (ratios[r] / np.linalg.norm(ratios[r])) for r in rows]
    assert margins[0] > 0 and margins[1] > 0 and margins[2] < 0 and margins[3] < 0


def test_logistic_curve_rises():
    slope, offset = nbsvm.logistic(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0, 0, 1, 1]))
    assert slope > 0 and abs(offset) < 0.5


def test_held_out_accuracy(spark, table):
    rows, labels = corpus(300)
    own = spark.createDataFrame(labels, "doc_id long, label int")
    model = nbsvm.fit(table(rows), own.where("doc_id % 5 != 0"))
    got = {r.doc_id: r.score for r in nbsvm.score(table(rows), model).collect()}
    held = [(got[k] >= 0.3) == bool(y) for k, y in labels if k % 5 == 0]
    assert len(got) == 300 and sum(held) / len(held) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())
    again = nbsvm.fit(table(rows), own.where("doc_id % 5 != 0"), max_rows=80)
    assert {r.doc_id for r in nbsvm.score(table(rows), again, keep=True).collect()} == set(got)


@pytest.mark.parametrize("labels", [[], [(5, 1), (6, 1)], [(None, 0), (5, None), (77, 0)]])
def test_odd_tables(spark, table, odd_rows, labels):
    model = nbsvm.fit(table(odd_rows), spark.createDataFrame(labels, "doc_id long, label int"))
    got = nbsvm.score(table(odd_rows), model, keep=True)
    assert got.columns == [*table(odd_rows).columns, "score"]
    scores = [r[-1] for r in got.collect()]
    assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores)
    assert nbsvm.score(table([]), model).collect() == []


def test_rows_of_one_key_keep_to_the_bound(spark, table, monkeypatch):
    seen = []
    curve = nbsvm.logistic
    monkeypatch.setattr(nbsvm, "logistic", lambda margins, labels: seen.append(len(margins)) or curve(margins, labels))
    rows, labels = corpus(100)
    own = spark.createDataFrame(labels, "doc_id long, label int")
    copies = table(rows + [rows[0]] * 600)
    plain, hot = nbsvm.fit(table(rows), own, max_rows=100), nbsvm.fit(copies, own, max_rows=100)
    assert np.array_equal(plain.ratios, hot.ratios) and seen[0] == seen[1]
    several = table(rows + [(0, f"{rows[0][1]} {k}") for k in range(2000)])
    nbsvm.fit(several, own, max_rows=100)
    assert 0 < seen[2] <= 45
