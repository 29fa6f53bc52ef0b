import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wardline.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[2], doc[3], doc[4], text)))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    """(left, right) of the node and its ancestors, bottom up."""
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 16])))
        at //= 16
    return out


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(docs):
    """Rows of the query, from nested lists."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf_of(d, d[1]), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for at, (_, _, leaf, d) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(top, k)
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            now = leaf_of(d, lowered(d[1])) if tampered else leaf
            for left, right in path:
                now = sha(left + now + right)
            proof = sha("".join(left + right for left, right in path))
            out.append((d[0], leaf, trees[s][-1][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def query(spark, tmp_path, docs):
    from wardline.llm.queries import QUERIES

    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in QUERIES["op12_merkle"](spark, str(tmp_path)).collect()), key=repr)


def test_odd_tables(spark, table, odd_rows, tmp_path):
    """Nulls in all columns, groups of one and of more than 16 * 16 rows, repeated rows, clashing names."""
    docs = [(k, t, s, None if k == 4 else "en", None if t is None else len(t)) for k, t in odd_rows for s in ("a", None, "é", "")]
    docs += [(k, f"Text {k % 7}", "hot", "de", k) for k in range(600)] + [(9, "A b", f"one{k}", "fr", 3) for k in range(20)]
    docs += [(1, "Same", "same", "fr", 3)] * 300
    assert query(spark, tmp_path, table(docs, SCHEMA)) == by_hand(docs)


@pytest.mark.parametrize("docs", [[], [(5, "Lone", "s", "en", 4)], [(None, None, None, None, None)], [(k, "T", "s", "en", k) for k in range(17)]])
def test_small_tables(spark, table, tmp_path, docs):
    assert query(spark, tmp_path, table(docs, SCHEMA)) == (by_hand(docs) if docs else [])


def test_requests_descend_by_digits(spark):
    """Paths of single rows are those of the proofs of all rows, and the records are addressed by content."""
    rows = spark.range(1000).select(
        F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("group"), merkle.leaf_digest(F.col("id")).alias("leaf"))
    manifest = merkle.build(rows)
    wanted = spark.createDataFrame([(0, 0), (0, 333), (2, 17), (2, 17), (1, 999)], "tree long, rank long")  # the last is no row
    some, every = (
        {r.key: (r.leaf, r.path) for r in merkle.prove(manifest, w).collect()} for w in (wanted, None))
    assert set(some) == {0, 999, 53} and len(every) == 1000
    assert all(every[k] == v for k, v in some.items())
    for digest, children in manifest.records.collect():
        assert hashlib.sha256(children.hex().encode()).digest() == digest


def test_query(spark, sf_dir):
    from wardline.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars").collect()]
    got = QUERIES["op12_merkle"](spark, sf_dir).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(docs)
