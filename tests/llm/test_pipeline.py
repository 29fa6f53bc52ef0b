import hashlib

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from wardline.llm import queries


def test_registered():
    names = entry_point.queries()
    assert [n for n in names if n.startswith("op")] == [n for n in queries.QUERIES] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "clean", "tokens"]


def test_stages_on_planted_cases(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    plain = docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 3000 AND text NOT LIKE '%|%' AND text NOT LIKE '%***%' AND text NOT LIKE '%!!%'").orderBy("doc_id").first()
    base = plain.text
    changed = base.split(" ")
    changed[40] = "changedword"
    planted = spark.createDataFrame(
        [(9001, base, "en", "s", 1), (9002, " ".join(changed), "en", "s", 1), (9003, base.replace("\n", " ") + "\n" + item, "en", "s", 1)], docs.schema
    )
    now = docs.unionByName(planted)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "tokens":
            assert now.columns == docs.columns
    assert {9001, 9002, 9003, plain.doc_id} <= kept["quality"]
    assert 9001 not in kept["lines"] and plain.doc_id in kept["lines"]
    assert not {9003} & kept["clean"] and plain.doc_id in kept["near"]
    assert kept["tokens"] == kept["clean"]
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/clean").collect()}
    for r in now.collect():
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name_ in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{sf_dir}/{name_}.parquet'")
    df = entry_point.queries()[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("texts", [[], [None, "", " \n"]])
def test_pipeline_without_words(spark, sf_dir, tmp_path, texts):
    """No documents, or none with a word: nothing fails, and what is left has no tokens but those of white space."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(k, t, None if k else "en", None, len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(range(len(texts))) and all(r.n_tokens <= 2 for r in got)
