"""The driver contract. Set ALL_CHECKS=1 to compare every registered query with its SQL."""

import os

import pytest

import __spark_entry__ as entry_point

ALWAYS = ["scan_needles_response", "scan_tools", "analyze_with_baseline", "definition_drift", "label_stats", "base_cases"]
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("ALL_CHECKS") else ALWAYS


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def test_registry():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(sql) > 80


def test_flagship_query(spark, sf_dir):
    df = entry_point.entry(spark)
    assert df.columns == ["signal", "severity", "findings", "names"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    df = entry_point.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(entry_point.oracle_sql()[name])
    place = [c[0] for c in result.description]
    assert sorted(place) == columns
    assert got == sorted(tuple(plain(r[place.index(c)]) for c in columns) for r in result.fetchall())


def test_tables_of_one_part_are_dealt_out_on_a_cluster_too():
    from types import SimpleNamespace as Of

    from checks.inputs import dealt

    def parts(master, n, cores=6):
        spark = Of(sparkContext=Of(master=master, defaultParallelism=cores), conf={"spark.sql.shuffle.partitions": "200"})
        kept = Of(sparkSession=spark, rdd=Of(getNumPartitions=lambda: n), repartition=lambda k: k)
        return n if (out := dealt(kept)) is kept else out

    assert parts("local-cluster[3,2,3000]", 1) == 200 and parts("local-cluster[3,2,3000]", 6) == 6
    assert parts("local[6]", 1) == 6 and parts("local[6]", 9) == 9
