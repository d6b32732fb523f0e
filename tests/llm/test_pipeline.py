"""The pipeline stage by stage, and the registered queries of the operators."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from reposift.llm import queries
from reposift.llm.common import staged

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    prose = ["the thing was other and", "der die das ist schön", "le la des êtes"]
    rows = [(i, f"{prose[i % 3]} " * 3 + f"number {i} " + " ".join(f"w{i}x{k}" for k in range(30)), ["en", "de", "fr"][i % 3], f"s{i % 2}", 10) for i in range(60)]
    rows += [(100, rows[4][1], "en", "s0", 10), (101, None, "en", "s1", 0), (102, "123 456", None, None, 7), (103, "mail the thing to a.b@c.org now " + " ".join(f"own{k}" for k in range(40)), "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (_, language), (_, copies), (_, personal), (_, mixture), (_, tokens) = corpus_pipeline.STAGES
    after = {}
    for name, stage in (("language", language), ("copies", copies), ("personal", personal), ("mixture", mixture)):
        docs = staged(stage(spark, docs, FOLDER), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        after[name] = docs.collect()
    ids = {name: [r["doc_id"] for r in kept] for name, kept in after.items()}
    assert set(ids["language"]) == {r[0] for r in rows} - {101, 102}
    assert 4 in ids["copies"] and 100 not in ids["copies"] and len(ids["copies"]) == len(set(ids["copies"]))
    changed = {r["doc_id"]: r for r in after["personal"]}
    assert "mail the thing to [EMAIL] now" in changed[103]["text"] and changed[103]["n_chars"] == len(changed[103]["text"])
    assert all(changed[i]["text"] == rows[i][1] for i in range(60) if i in changed)
    assert max(map(ids["mixture"].count, ids["mixture"])) == 2 and set(ids["mixture"]) <= set(ids["personal"])
    told = tokens(spark, docs, FOLDER)
    assert told.count() == len(ids["mixture"]) and "n_tokens" in told.columns


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words=60):
    return f"the thing was other and {seed} " + " ".join(f"w{seed}x{k}" for k in range(words))


def test_near_copies_lose_no_document(spark):
    """Rows are documents, whatever their ids: only copies go."""
    rows = [(1, prose("a"), "en", "s", 1), (2, prose("a"), "en", "s", 1), (2, prose("b"), "en", "s", 1), (None, prose("c"), "en", "s", 1),
            (None, prose("c"), "en", "t", 1), (None, prose("d"), "en", "s", 1), (3, prose("e"), "en", "s", 1), (3, prose("e"), "en", "s", 1),
            (None, prose("e"), "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    rows += [(7, prose("hot"), "en", "s", 1)] * 40
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()]
    want = [(1, prose("a")), (2, prose("b")), (None, prose("c")), (None, prose("d")), (3, prose("e")), (4, None), (7, prose("hot"))]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_mixture_takes_rows_not_ids(spark):
    rows = [(i % 5, prose(i, 40 + i), "en", "s" if i % 2 else None, 1) for i in range(40)] + [(None, prose(i, 40 + i), "en", "s", 1) for i in range(40, 60)]
    rows += [(9, prose("same"), "en", "s", 1)] * 6 + [(10, "", "en", "s", 0), (11, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = corpus_pipeline.mixing.mix_sources(docs, keep=("text",)).where("times > 0").collect()
    want = sorted((r["doc_id"], r["text"]) if r["doc_id"] is not None else (-1, r["text"]) for r in mixed for _ in range(r["times"]))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in corpus_pipeline.mixture(spark, docs, FOLDER).collect())
    assert got == want


def test_stages_on_empty_tables_and_clashing_columns(spark):
    kinds = SCHEMA + ", size int, key string, fp long, spans string, times long, _rows int, root int"
    empty = spark.createDataFrame([], kinds)
    some = spark.createDataFrame([(1, prose("a"), "en", "s", 1, 1, "k", 2, "x", 3, 4, 5), (None, None, None, None, None, *[None] * 7)], kinds)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, empty, FOLDER).count() == 0
        assert stage(spark, some, FOLDER).columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.tokens(spark, empty, FOLDER).count() == 0 and corpus_pipeline.tokens(spark, some, FOLDER).count() == 2


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    df, cur = queries.QUERIES[name](spark, FOLDER), con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(repr(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert sorted(tuple(repr(r[c]) for c in sorted(columns)) for r in df.collect()) == want
