"""Registered queries against DuckDB on the smallest tables.

A few of each kind run by default; REPOSIFT_ALL_QUERIES=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["knn_topk", "find_duplicates", "recommend_reviewers", "clean_text", "scored_pair_corpus", "cascade", "best_threshold", "route_events"]
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("REPOSIFT_ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(repr(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    got = sorted(tuple(repr(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


def test_registry():
    own = {name for name in QUERIES if not (name.startswith("op") and name[2].isdigit()) and name != "pipeline"}
    assert set(SQL) <= set(QUERIES) and own == set(SQL) - {name for name in SQL if name not in own}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo_name", "pr_number", "author", "relevance_score", "rnk"] and df.count() > 0
