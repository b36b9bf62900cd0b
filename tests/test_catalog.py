"""Every registered query against its SQL on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def _plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


def _check(spark, oracle, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[k]) for k in columns) for r in df.collect()), key=_key)
    result = oracle.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(k)]) for k in columns) for r in result.fetchall()), key=_key)
    assert rows == want


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, oracle, name):
    _check(spark, oracle, name)


@pytest.mark.parametrize("name", ["w1_chat_history", "w4_log_section", "w5_log_tail", "w6_log_context", "w7_merge_positions", "w8_with_ordinal",
                                  "a2_citations", "a4_job_summary", "u2_merge_indexes"])
def test_query_with_every_group_hot(spark, oracle, tight, name):
    _check(spark, oracle, name)


@pytest.mark.parametrize("name", ["q1_search", "q5_retrieve_rerank", "j5_within_radius"])
def test_query_with_many_blocks(spark, oracle, name):
    settings = {"spark.corpusflow.broadcastQueries": "10", "spark.corpusflow.blockQueries": "64", "spark.corpusflow.blockVectors": "100"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        _check(spark, oracle, name)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_names():
    # token ids, trained models, page layout and their pipeline cannot be put into SQL
    assert {n for n in entry_points.queries() if n not in entry_points.oracle_sql()} <= {
        n for n in entry_points.queries() if n.startswith("op") or n == "pipeline"}
