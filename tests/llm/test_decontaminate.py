import random
import re

import pytest

from wardline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    own = {}
    for item, text in items:
        w = cut(text)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            own.setdefault(tuple(w[a:a + size]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in {len(k) for k in own}:
            for a in range(len(w) - size + 1):
                if (k := tuple(w[a:a + size])) in own:
                    hit |= set(range(a, a + size))
                    found |= {str(i) for i in own[k] if i is not None}
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def found(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.report(docs, items).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agrees_with_brute_force(spark, table, seed):
    draw = random.Random(seed)
    say = lambda n: " ".join(draw.choice("alpha Beta gamma delta été".split()) for _ in range(n))
    items = [(k, say(draw.choice([0, 1, 3, 6, 12, 25]))) for k in range(8)] + [(None, say(11)), (3, say(14)), (90, None)]
    docs = [(k, say(draw.choice([0, 2, 15, 60]))) for k in range(25)]
    docs += [(100 + k, f"{say(7)}, {t} {say(3)}") for k, (_, t) in enumerate(items) if t] + [(100, docs[3][1])]
    assert found(table(docs), table(items, "item_id long, text string")) == brute(docs, items)


def test_odd_tables(spark, table, odd_rows):
    items = [(1, "one TWO three, four"), (2, ""), (3, None), (4, odd_rows[6][1][:300])]
    bench = table(items, "item_id long, text string")
    assert found(table(odd_rows), bench) == brute(odd_rows, items)
    assert found(table([]), bench) == []
    none = table([], "item_id long, text string")
    assert [r[2:] for r in found(table(odd_rows), none)] == [(0, [])] * len(odd_rows)
    kept = decontaminate.apply(table(odd_rows), bench)
    assert kept.columns == table(odd_rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [-9, 0, 1, 2, 3, 7, 8]
