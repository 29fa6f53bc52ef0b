import numpy as np
from pyspark.sql import functions as F

from wardline.llm import collision_nn


def brute(rows, k):
    own = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in own:
        if q % 10 == 0:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in own if i != q and len(w) == len(v))
            out[q] = far[:k]
    return out


def found(df, k, **more):
    got = {}
    for r in collision_nn.search(df, F.col("id") % 10 == 0, k=k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_distances(table):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((900, 24))
    data[300:600] = data[300] + 0.05 * rng.standard_normal((300, 24))
    data[600:700] = data[600]  # one vector many times
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    df = table(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows, 10), found(df, 10, block=200, sample=100)
    assert set(want) == set(got)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.95
    for q in range(600, 700, 10):
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    for q, near in got.items():
        assert near == sorted(near) and all(np.isclose(d, np.linalg.norm(data[q] - data[i]), rtol=1e-12) for d, i in near)


def test_odd_tables(table):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (10, [0.0, 0.0]), (20, None), (30, []), (40, [nan, 1.0]), (50, [None, 1.0]), (60, [inf, 1.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]
    rows += [(None, [1.0, 1.0]), (70, [1.0, 2.0, 3.0]), (2, [0.5, 0.0]), (80, [1.0, 0.0])]
    df = table(rows, "vec_id long, embedding array<double>")
    assert found(df, 10) == {0: [(0.0, 1), (0.0, 80), (0.5, 2), (0.5, 2)], 80: [(0.0, 0), (0.0, 1), (0.5, 2), (0.5, 2)]}
    assert found(table([], "vec_id long, embedding array<double>"), 10) == {}
