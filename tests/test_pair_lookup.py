"""Looked-up values against a join, and how often a value travels."""

import pytest

from reposift.operators import pair_lookup as L
from reposift.operators import pairs as P


def tables(spark):
    pairs = [("a", i, j, f"{i}-{j}") for i in range(30) for j in range(i) if (i + j) % 3] + [("b", 2, 1, "x"), ("gone", 2, 1, "y"), (None, 2, 1, "z"), ("a", None, 1, "n"), ("a", 99, 98, "m")]
    values = [("a", i, [float(i), 0.5]) for i in range(28)] + [("a", 5, [-5.0]), ("b", 1, None), ("b", 2, [2.0]), (None, 1, [9.0]), ("a", None, [8.0])]
    return (spark.createDataFrame(pairs, "repo string, issue_1_number long, issue_2_number long, note string").repartition(3),
            spark.createDataFrame(values, "repo string, issue_number long, value array<float>").repartition(3))


@pytest.mark.parametrize("missing", [True, False])
@pytest.mark.parametrize("block, batch", [(16384, 1024), (7, 3), (1, 1)])
def test_equals_a_join(spark, monkeypatch, missing, block, batch):
    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    monkeypatch.setattr(L, "BATCH_ROWS", batch)
    pairs, values = tables(spark)
    want = pairs
    for n in (1, 2):
        side = values.withColumnsRenamed({"issue_number": f"issue_{n}_number", "value": f"v{n}"})
        want = want.join(side, ["repo", f"issue_{n}_number"], "left" if missing else "inner")
    got = L.look_up(pairs, values, ("v1", "v2"), missing)
    assert got.columns == ["repo", "issue_1_number", "issue_2_number", "note", "v1", "v2"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_nothing_to_look_up(spark):
    pairs, values = tables(spark)
    assert L.look_up(pairs, values.limit(0), ("v1", "v2"), True).count() == pairs.count()
    assert L.look_up(pairs, values.limit(0), ("v1", "v2"), False).count() == L.look_up(pairs.limit(0), values, ("v1", "v2"), True).count() == 0


def test_no_pair_is_shuffled_with_a_value(spark):
    """A join shuffled every pair with the first vector beside it."""
    pairs, values = tables(spark)
    text = P.pair_embeddings(pairs, values.withColumnRenamed("value", "embedding"))._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "SortMergeJoin" not in above
