import numpy as np
import pytest

from reposift.operators import lsh
from reposift.operators import neighbours as N

SCHEMA = "repo_name string, issue_number long, title string, embedding array<float>"


def brute(rows, k, exclude_self=False, earlier_only=False, queries=None):
    out = set()
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(np.asarray(v, float)) or 1.0)
    for q in queries or rows:
        found = []
        for v in rows:
            if v[0] != q[0] or (exclude_self and v[1] == q[1]) or (earlier_only and v[1] >= q[1]):
                continue
            found.append((-round(float(unit(q[3]) @ unit(v[3])), 9), v[1]))
        for rank, (sim, number) in enumerate(sorted(found)[:k], 1):
            out.add((q[0], q[1], number, rank))
    return out


def made(seed=1, n=240, dim=8):
    """One repository holds most rows, with many exact copies and a zero vector; two are small."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        repo = "hot" if i % 4 else ("b" if i % 8 else "c")
        v = np.ones(dim) if i % 6 == 0 else centres[i % 5] + rng.normal(scale=0.2, size=dim)
        rows.append((repo, i + 1, f"T{i}", [float(np.float32(x)) for x in (v * 0 if i == 7 else v)]))
    return rows


def found(df):
    return {(r.repo_name, r.query_number, r.match_number, r.rnk) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("options", [{}, {"n_clusters": 1, "block_rows": 25}, {"n_clusters": 6, "block_rows": 15}],
                         ids=["one block", "salted", "pivots"])
@pytest.mark.parametrize("mode", [{}, {"exclude_self": True}, {"earlier_only": True}], ids=["plain", "others", "earlier"])
def test_exact_search(table, rows, options, mode):
    assert found(N.knn_topk(table, table, 4, **mode, **options)) == brute(rows, 4, **mode)


def test_other_queries(spark, table, rows):
    asked = [r for r in made(seed=2, n=60)] + [("unknown", 1, "T", [1.0] * 8)]
    queries = spark.createDataFrame(asked, SCHEMA)
    wanted = brute(rows, 3, queries=asked)
    assert found(N.knn_topk(queries, table, 3)) == wanted
    assert found(N.knn_topk(queries, table, 3, n_clusters=5, block_rows=20)) == wanted


def test_more_matches_contain_fewer(table):
    few, many = (found(N.knn_topk(table, table, k, n_clusters=4, block_rows=40)) for k in (2, 3))
    assert few <= many


def test_approximate_is_part_of_all_pairs(table, rows):
    near = N.probe_join(table, table, 5, n_clusters=8, n_probe=2, exclude_self=True, block_rows=20)
    exact = {(r.repo_name, r.query_number, r.match_number): r.similarity_score
             for r in N.knn_topk(table, table, 240, exclude_self=True).collect()}
    for r in near.collect():
        assert exact[r.repo_name, r.query_number, r.match_number] == pytest.approx(r.similarity_score, abs=1e-9)
    full = N.probe_join(table, table, 4, n_clusters=8, n_probe=8, exclude_self=True, block_rows=20)
    assert found(full) == brute(rows, 4, exclude_self=True)


def test_recall_on_clustered_vectors(table):
    exact = N.knn_topk(table, table, 3, exclude_self=True)
    row = N.recall(N.probe_join(table, table, 3, n_clusters=8, n_probe=4, exclude_self=True), exact).first()
    assert row.expected == exact.count() and row.recall > 0.8


def test_small_repositories_get_all_their_matches(spark):
    import random

    draw = random.Random(3)
    sizes = {"large": 600, **{f"r{i}": i % 5 + 1 for i in range(30)}}
    rows = [(repo, n, "t", [draw.gauss(0, 1) for _ in range(8)]) for repo, size in sizes.items() for n in range(size)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = N.probe_join(table, table, 3, n_clusters=40, n_probe=1, exclude_self=True).groupBy("repo_name", "query_number").count().collect()
    counts = {(r.repo_name, r.query_number): r["count"] for r in got}
    assert all(counts.get((repo, n), 0) == min(3, sizes[repo] - 1) for repo, n, _, _ in rows)


def test_decision(spark):
    rows = [("r", 1, "a", [1.0, 0.0]), ("r", 2, "b", [0.85, 0.5267826876426369]), ("r", 3, "c", [-1.0, 0.0]), ("s", 1, "d", [1.0, 0.0])]
    got = {(r.repo_name, r.issue_number): (r.is_duplicate, round(r.similarity_score, 6), r.duplicate_of_number)
           for r in N.duplicate_decision(*[spark.createDataFrame(rows, SCHEMA)] * 2).collect()}
    assert got["r", 1] == (True, 0.85, 2) and got["r", 2] == (True, 0.85, 1)
    assert got["r", 3] == (False, 0.0, None) and got["s", 1] == (False, 0.0, None)


def test_parameters(table):
    for bad in (lambda: N.knn_topk(table, table, 0), lambda: N.duplicate_decision(table, table, 1.01),
                lambda: N.probe_join(table, table, n_clusters=4, n_probe=0)):
        with pytest.raises(ValueError):
            bad()


def test_hash_tables_find_nine_of_ten_matches_of_the_given_vectors(spark):
    """The registered query at both sizes; its vectors are nearly orthogonal, so most pairs meet in some table."""
    from catalog import vectors as V

    for size in ("0.01", "0.1"):
        folder = f"/root/testdata/sf{size}"
        vectors = V._vectors(spark, folder)
        row = N.recall(V.ann_join(spark, folder), N.knn_topk(vectors, vectors, 3, exclude_self=True)).first()
        assert row.expected == 3 * vectors.count() and row.recall >= 0.9


def test_hash_tables_on_clustered_vectors(table, rows):
    """Few comparisons there: most matches are found though only one pair in a few shares a bucket."""
    found_by = lsh.ann_join(table, table, 3, tables=8, hashes=4, width=0.8, exclude_self=True, block_rows=20)
    exact = {(r.repo_name, r.query_number, r.match_number): r.similarity_score for r in N.knn_topk(table, table, 240, exclude_self=True).collect()}
    for r in found_by.collect():
        assert exact[r.repo_name, r.query_number, r.match_number] == pytest.approx(r.similarity_score, abs=1e-9)
    assert N.recall(found_by, N.knn_topk(table, table, 3, exclude_self=True)).first().recall >= 0.9
    wide = lsh.ann_join(table, table, 4, tables=1, hashes=1, width=1e9, exclude_self=True, block_rows=20)
    assert found(wide) == brute(rows, 4, exclude_self=True)


def test_a_hot_bucket_is_many_blocks(spark):
    rows = [("r", n, "t", [1.0, float(n % 3)]) for n in range(200)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = lsh.ann_join(table, table, 2, tables=2, hashes=1, width=50.0, exclude_self=True, block_rows=16)
    assert found(got) == brute(rows, 2, exclude_self=True)


def test_many_queries_against_an_empty_table(spark):
    """More queries than fit one block, but nothing stored yet, as in the first batch of a stream."""
    kind = "repo_name string, issue_number long, title string, embedding array<float>"
    queries = spark.createDataFrame([("r", n, "t", [1.0, float(n)]) for n in range(9)], kind)
    empty = spark.createDataFrame([], kind)
    assert N.knn_topk(queries, empty, 1, exclude_self=True, block_rows=2).count() == 0
    assert N.probe_join(queries, empty, 1, n_clusters=2, n_probe=1, block_rows=2).count() == 0
    verdicts = N.duplicate_decision(queries, empty, block_rows=2).collect()
    assert len(verdicts) == 9 and not any(v.is_duplicate for v in verdicts)


def test_blocks_travel_in_bundles(spark, monkeypatch):
    """Vectors without clusters: each is sent to every bundle of its repository at most, however small the blocks are."""
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 5 else "b", i, "t", [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    sent, run = [], N._multiply_bundles

    def counted(visits, *rest):
        sent.append(visits.count())
        return run(visits, *rest)

    monkeypatch.setattr(N, "_multiply_bundles", counted)
    for limits in ({}, {"BUNDLE_ROWS": 60, "SPREAD": 2, "TILE": 500}):
        for name, value in limits.items():
            monkeypatch.setattr(N, name, value)
        assert found(N.knn_topk(table, table, 4, exclude_self=True, n_clusters=4, block_rows=5)) == brute(rows, 4, exclude_self=True)
    # bundles of 30 and 60 rows, whose number rounds up for each of four clusters: not the 48 blocks of five rows
    assert sent[1] <= 240 * (4 + 4) + 60 * (2 + 4) < sum(n * n / 5 for n in (240, 60)) / 4
