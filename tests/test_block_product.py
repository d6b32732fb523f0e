"""Sums of blocks against plain computations, whatever the sizes of blocks and tiles."""

import numpy as np
import pyarrow as pa
import pytest

from reposift.operators import block_product as B
from reposift.operators import pairs as P


def vectors(n=70):
    rng = np.random.default_rng(4)
    return [{int(t): float(rng.random()) for t in rng.integers(0, 40, rng.integers(1, 12))} for _ in range(n)]


def wanted(rows, least):
    return {(a, b): sum(x * rows[b].get(t, 0.0) for t, x in rows[a].items()) for a in range(len(rows)) for b in range(a)
            if sum(x * rows[b].get(t, 0.0) for t, x in rows[a].items()) >= least}


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARED_ROWS", 9)
    monkeypatch.setattr(B, "BLOCK_ROWS", 20)
    rows = vectors()
    table = [("g", n, t, x) for n, row in enumerate(rows) for t, x in row.items()] + [(None, 1, 2, 1.0), ("g", None, 2, 1.0), ("h", 1, 2, 9.0)]
    df = spark.createDataFrame(table, "g string, n long, term long, weight double")
    got = B.block_products(df, "g", "n", 0.5).collect()
    want = wanted(rows, 0.5)
    assert len(got) == len(want) and {(r.number_1, r.number_2): r.cosine for r in got} == pytest.approx(want)
    assert {r.g for r in got} == {"g"}


@pytest.mark.parametrize("tile, meetings, dense", [(8, 3, 0.004), (16, 1000, 0.0), (1024, 7, 2.0)])
@pytest.mark.parametrize("alone", [True, False])
def test_tiles_dense_columns_and_postings(monkeypatch, tile, meetings, dense, alone):
    for name, value in (("TILE_ROWS", tile), ("MEETINGS", meetings), ("DENSE", dense)):
        monkeypatch.setattr(B, name, value)
    rows = vectors()
    table = pa.table({
        "second": [not alone and n % 2 == 1 for n in range(len(rows))], "number": list(range(len(rows))),
        "terms": pa.array([list(r) for r in rows], pa.list_(pa.int64())), "weights": pa.array([list(r.values()) for r in rows])})
    key = (pa.scalar("g"), pa.scalar(0), pa.scalar(0 if alone else 1))
    made = B._meet("g", 0.5, ["g", "number_1", "number_2", "cosine"])(key, iter(table.to_batches(max_chunksize=20)))
    got = [(r["number_1"], r["number_2"], r["cosine"]) for batch in made for r in batch.to_pylist()]
    want = {k: v for k, v in wanted(rows, 0.5).items() if alone or (k[0] + k[1]) % 2}
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == pytest.approx(want)


def test_issue_table_looks_texts_up_once(spark):
    pairs = spark.createDataFrame([("r", 3, 2), ("r", 2, 1), ("r", 3, 1)], "repo string, issue_1_number long, issue_2_number long")
    texts = spark.createDataFrame([("r", n, f" t{n} ") for n in range(1, 6)], "repo string, issue_number long, issue_text string")
    assert {r.issue_number: r.issue_text for r in P.issue_table(pairs, texts).collect()} == {1: "t1", 2: "t2", 3: "t3"}
