import random
from itertools import combinations

from wardline.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(draw, text, n):
    out = list(text)
    for _ in range(n):
        k = draw.randrange(len(out) + 1)
        out[k:k + draw.randrange(2)] = draw.choice(["", "x", "é", "yz"][:3])
    return "".join(out)


def brute(docs, edits=2, min_chars=20, near_chars=40):
    lines = [(k, row, i, line_dedup.normal(x)) for row, (k, t) in enumerate(docs) for i, x in enumerate(t.split("\n") if t else [])]
    own = sorted({x for *_, x in lines if len(x) >= min_chars})
    root = {x: x for x in own}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations([x for x in own if len(x) >= near_chars], 2):
        if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
            root[top(a)] = top(b)
    seen, out = {}, {row: (k, len(t.split("\n")) if t else 0, [], set()) for row, (k, t) in enumerate(docs)}
    for k, row, i, x in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2])):
        if len(x) >= min_chars:
            if top(x) in seen:
                out[row][2].append(i)
                out[row][3].add(seen[top(x)])
            else:
                seen[top(x)] = k
    return sorted(((k, n, d, sorted(c - {None})) for k, n, d, c in out.values()), key=repr)


def found(df):
    _, got = line_dedup.find(df)
    return sorted(((r.key, r.n_lines, list(r.dropped), [c for c in r.copies_of if c is not None]) for r in got.collect()), key=repr)


def test_band_automaton_and_keys():
    draw = random.Random(1)
    for _ in range(3000):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(14)))
        b = edited(draw, a, draw.randrange(5))
        for edits in (0, 1, 2, 3):
            near = distance(a, b) <= edits
            assert line_dedup.within(a, b, edits) == near
            if near and edits and min(len(a), len(b)) > edits:
                short, long = sorted((a, b), key=len)
                keys, own = line_dedup.keys(short, edits)
                assert {k for k, o in zip(keys, own, strict=True) if o} & set(line_dedup.keys(long, edits)[0])


def test_bigram_signs_never_part_near_lines():
    draw = random.Random(6)
    for _ in range(2000):
        a = "".join(draw.choice("abc é😀") for _ in range(draw.randrange(300)))
        for n in (1, 2):
            pair = zip(line_dedup.bigram_signs(a), line_dedup.bigram_signs(edited(draw, a, n)), strict=True)
            assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in pair) <= 4 * n


def test_versions_of_a_template_make_few_pairs(spark):
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("aehinorst") for _ in range(draw.randrange(4, 7))) for _ in range(200)]
    words = [draw.choice(vocabulary) for _ in range(70)]
    lines = {" ".join(words)}
    for _ in range(150):
        own = list(words)
        for _ in range(3):
            at = draw.randrange(70)
            own[at] = "".join(draw.sample(own[at], len(own[at])))  # letter counts stay
        lines.add(" ".join(own))
    lines |= {edited(draw, x, 2) for x in sorted(lines)[:20]}
    rows, keyed = [], {}
    for x in sorted(lines):
        found, own = line_dedup.keys(x, 2)
        sketch = [line_dedup.letter_counts(x), *line_dedup.bigram_signs(x)]
        for k, o in set(zip(found, own, strict=True)):
            rows.append((k - (1 << 63), o, x.encode(), len(x), sketch, x.encode()))
            keyed.setdefault(k, []).append((x, o))
    table = spark.createDataFrame(rows, "key long, own boolean, node binary, size int, sketch array<long>, root binary")
    got = [(bytes(r.a).decode(), bytes(r.b).decode()) for r in line_dedup._across(table, 2).collect()]
    near = {tuple(sorted(p)) for p in combinations(lines, 2) if line_dedup.within(*p, 2)}
    assert len(near) >= 15 and near <= set(got)
    met = sum(abs(len(x) - len(y)) <= 2 for group in keyed.values() for (x, o), (y, p) in combinations(group, 2) if o or p)
    assert len(got) < met / 10  # the letter counts alone leave nearly all


def test_agrees_with_brute_force(table):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.choice([10, 30, 60, 90]))) for _ in range(12)]
    docs = []
    for k in range(30):
        own = [edited(draw, draw.choice(base), draw.randrange(5)).upper() if draw.random() < 0.3 else draw.choice(base) for _ in range(draw.randrange(6))]
        docs.append((draw.randrange(25), "\n".join(own)))
    assert found(table(docs).coalesce(1)) == brute(docs)


def test_dense_group(table):
    docs = [(k, f"a line that only differs in its number, which is {k:03d} here") for k in range(130)]
    assert found(table(docs).coalesce(1)) == brute(docs)


def test_odd_tables(table, odd_rows):
    assert found(table(odd_rows).coalesce(1)) == brute(odd_rows)
    assert found(table([])) == []
    kept = line_dedup.apply(table(odd_rows))
    assert kept.columns == table(odd_rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [-9, 0, 1, 2, 3, 4, 4, 5, 7, 8]


def test_the_queries_find_edited_short_lines(spark, tmp_path):
    from wardline.llm import queries

    docs = [(1, "a line of 27 characters xyz\nb"), (2, "c\na line of 27 charicters xyz"), (3, "a line of 2 characters xy"), (4, "twenty characters yz"), (5, "twenty charactes yz!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_line_dedup(spark, str(tmp_path))
    rows = sorted((r.doc_id, r.n_lines, list(r.dropped), list(r.copies_of)) for r in got.collect())
    assert rows == brute(docs, near_chars=20) and rows != brute(docs)


def test_agrees_with_brute_force_from_the_least_length(table):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.choice([15, 22, 30, 60]))) for _ in range(10)]
    docs = [(k, "\n".join(edited(draw, draw.choice(base), draw.randrange(4)) for _ in range(draw.randrange(6)))) for k in range(30)]
    _, got = line_dedup.find(table(docs).coalesce(1), near_chars=20)
    rows = sorted(((r.key, r.n_lines, list(r.dropped), list(r.copies_of)) for r in got.collect()), key=repr)
    assert rows == brute(docs, near_chars=20) and rows != brute(docs)


def test_keys_of_many_lines_are_those_of_each(spark):
    draw = random.Random(8)
    lines = ["".join(draw.choice("abc é😀") for _ in range(draw.randrange(3, 400))) for _ in range(200)]
    found, own, n = line_dedup._hasher(2)(lines)
    assert found.tolist() == [k for x in lines for k in line_dedup.keys(x, 2)[0]]
    assert own.tolist() == [o for x in lines for o in line_dedup.keys(x, 2)[1]] and n.tolist() == [len(line_dedup.keys(x, 2)[0]) for x in lines]
    assert len(set(found.tolist())) > 0.9 * len(found)
