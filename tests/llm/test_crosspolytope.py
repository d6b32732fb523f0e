"""Cross-polytope near vectors against all pairs."""

import numpy as np
import pytest

from reposift.llm import crosspolytope
from tests.llm.test_simhash import slow_components

SCHEMA = "vec_id long, embedding array<float>, label int, links long"


def brute(rows, least=0.98):
    sound = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            unit = np.array(vector, np.float32).astype(float)
            sound.append((i, label, unit / np.linalg.norm(unit)))
    links = [(i, j) for i, a, x in sound for j, b, y in sound if i < j and a == b and len(x) == len(y) and x @ y >= least]
    count = [sum(i in link for link in links) for i in range(len(rows))]
    return count, slow_components(range(len(rows)), links)


def clusters(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), (centre + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 0.3])).astype(np.float32).tolist(), int(c % 2)))
    return rows


@pytest.mark.parametrize("homes", [4, 2048])
def test_against_all_pairs(spark, monkeypatch, homes):
    monkeypatch.setattr(crosspolytope, "HOMES_PER_PART", homes)
    rows = clusters(1, 12)
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA).repartition(3)
    got = {r["vec_id"]: r for r in crosspolytope.near_vectors(df).collect()}
    count, roots = brute(rows)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert found >= 0.99 * sum(count) and all(got[i]["n_links"] <= count[i] for i in range(len(rows)))
    assert sum(got[i]["component_id"] == roots[i] for i in range(len(rows))) >= 0.98 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
            (8, [float("nan"), 1.0], 1), (9, [None, 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [1.0, 0.0], None), (12, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.0], 2), (2, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [-0.0, 1e-30], 1), (15, [0.0, 3e-30], 1)]
    got = crosspolytope.near_vectors(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    told = sorted(map(tuple, got.collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (None, 1, 4, False),
            *[(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 12, 13)], (14, 1, 14, True), (15, 1, 14, False)]
    assert told == sorted(want, key=repr)
    assert crosspolytope.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = crosspolytope.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(crosspolytope.hadamard(y), x)
    assert np.allclose(y @ y.T, x @ x.T)


def test_probes_begin_at_home():
    x = np.random.default_rng(0).normal(size=(50, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few, many = crosspolytope.bucket_codes(x, 2, 2, 1), crosspolytope.bucket_codes(x, 2, 2, 6)
    assert (few[:, :, 0] == many[:, :, 0]).all() and all(len(set(r)) == 6 for t in many for r in t)
