import random
import re
from itertools import combinations

import numpy as np

from wardline.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, words, percent):
    sets = []
    for _, text in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            low[top(i)] = min(low.get(top(i), key), key)
    return sorted(((key, len(sets[i]), low.get(top(i))) for i, (key, _) in enumerate(docs)), key=repr)


def found(df, words, percent):
    rows = near_dedup.find(df, words, percent).collect()
    assert sum(r.chosen for r in rows) >= len({r.component_id for r in rows})
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    say = lambda n: [f"w{draw.randrange(300)}" for _ in range(n)]
    docs = [(k, " ".join(say(draw.choice([0, 1, 2, 30, 80])))) for k in range(30)]
    base = say(120)
    for k in range(40):  # near copies of one text, of different distance, in a chain as well
        copy = list(base)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(len(copy))] = f"new{draw.randrange(1000)}"
        if k % 4 == 0:
            base = copy
        docs.append((100 - k, " ".join(copy)))
    return docs + [(500 + k, docs[40][1].upper() if k % 2 else docs[40][1]) for k in range(20)]


def test_agrees_with_brute_force(table):
    for seed, words, percent in ((1, 3, 85), (2, 5, 80)):
        docs = corpus(seed)
        assert found(table(docs), words, percent) == brute(docs, words, percent)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n in (20, 400, 2000):
        a, b = pool[:n], pool[n // 4:n + n // 4]
        same = [np.mean(near_dedup.signature(a + np.uint64(s)) == near_dedup.signature(b + np.uint64(s))) for s in range(20)]
        assert abs(np.mean(same) - 0.6) < 0.04
    one = near_dedup.signature(pool[:1])
    assert sorted((one >> np.uint64(48)).tolist()) == list(range(near_dedup.SLOTS))  # a permutation


def test_bands_miss_little():
    for t in (0.5, 0.8, 0.85):
        n, width = near_dedup.bands_for(t)
        assert n * width == near_dedup.SLOTS and (1 - t**width) ** n <= 1e-4


def test_odd_tables(table, odd_rows):
    assert found(table(odd_rows), 5, 80) == brute(odd_rows, 5, 80)
    assert found(table([]), 5, 80) == []
    kept = near_dedup.apply(table(odd_rows))
    assert kept.columns == table(odd_rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [-9, 0, 1, 2, 3, 4, 5, 7, 8]
