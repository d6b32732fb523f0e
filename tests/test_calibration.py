import math
import random

import pytest
from pyspark.sql import functions as F

from reposift.operators import calibration as K

SAMPLE = "similarity double, is_duplicate int"


def simulated(seed=3):
    rng = random.Random(seed)
    clip = lambda x, lo, hi: max(lo, min(hi, x))
    return ([(clip(rng.gauss(0.88, 0.05), 0.5, 1.0), 1) for _ in range(200)]
            + [(round(clip(rng.gauss(0.45, 0.15), 0.0, 1.0), 2), 0) for _ in range(800)])


def test_golden_curve(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1)], SAMPLE)
    curve = K.pr_curve(df).orderBy(F.desc("threshold")).collect()
    assert [r.precision for r in curve] == pytest.approx([1, 1, 2 / 3, 3 / 4])
    assert [r.recall for r in curve] == pytest.approx([1 / 3, 2 / 3, 2 / 3, 1])
    best = K.best_threshold(K.pr_curve(df)).first()
    assert best.threshold == 0.6 and best.f1 == pytest.approx(6 / 7)


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_two_levels_equal_one_window(spark, buckets):
    rows = simulated()
    got = {r.threshold: (r.precision, r.recall) for r in K.pr_curve(spark.createDataFrame(rows, SAMPLE), buckets).collect()}
    positives = sum(l for _, l in rows)
    assert set(got) == {s for s, _ in rows}
    for t, (precision, recall) in got.items():
        taken = [l for s, l in rows if s >= t]
        assert precision == pytest.approx(sum(taken) / len(taken)) and recall == pytest.approx(sum(taken) / positives)


def test_no_positives_and_empty(spark):
    assert {r.recall for r in K.pr_curve(spark.createDataFrame([(0.5, 0), (0.6, 0)], SAMPLE)).collect()} == {1.0}
    assert K.best_threshold(K.pr_curve(spark.createDataFrame([], SAMPLE))).count() == 0


def test_tie_goes_to_the_lowest_threshold(spark):
    curve = spark.createDataFrame([(0.3, 0.5, 0.5, 0.5), (0.2, 0.5, 0.5, 0.5), (0.9, 0.1, 0.1, 0.1)],
                                  "threshold double, f1 double, precision double, recall double")
    assert K.best_threshold(curve).first().threshold == 0.2


def test_histogram(spark):
    rows = K.similarity_histogram(spark.createDataFrame([(0.0, 0), (0.5, 0), (1.0, 1), (0.99, 1)], SAMPLE), bins=2).collect()
    assert {(r.is_duplicate, r.bin): r.rows for r in rows} == {(0, 0): 1, (0, 1): 1, (1, 1): 2}
    flat = K.similarity_histogram(spark.createDataFrame([(0.4, 0), (0.4, 1)], SAMPLE)).collect()
    assert sum(r.rows for r in flat) == 2


def test_density(spark):
    rows = simulated()
    got = K.similarity_kde(spark.createDataFrame(rows, SAMPLE), grid=11).collect()
    lo, hi = min(s for s, _ in rows), max(s for s, _ in rows)
    for r in got:
        mine = [s for s, l in rows if l == r.is_duplicate]
        mean = sum(mine) / len(mine)
        sd = math.sqrt(sum((s - mean) ** 2 for s in mine) / (len(mine) - 1))
        h = sd * len(mine) ** -0.2
        x = lo + r.point * (hi - lo) / 10
        want = sum(math.exp(-((x - s) / h) ** 2 / 2) for s in mine) / (len(rows) * h * math.sqrt(2 * math.pi))
        error = ((hi - lo) / 10 / K.KDE_CELLS / h) ** 2 / 8 / (h * math.sqrt(2 * math.pi))
        assert r.x == pytest.approx(x) and r.density == pytest.approx(want, abs=error)
    assert len(got) == 2 * 11


def test_density_is_the_sum_over_all_scores(spark):
    """Two far clusters give a bandwidth near the width of a bin, where binned scores would be off."""
    scores = [0.0001 * i for i in range(40)] + [1.0]
    got = K.similarity_kde(spark.createDataFrame([(s, 1) for s in scores], SAMPLE), grid=5).collect()
    mean = sum(scores) / len(scores)
    h = math.sqrt(sum((s - mean) ** 2 for s in scores) / (len(scores) - 1)) * len(scores) ** -0.2
    want = {k: sum(math.exp(-((k / 4 - s) / h) ** 2 / 2) for s in scores) / (len(scores) * h * math.sqrt(2 * math.pi)) for k in range(5)}
    assert {r.point: r.density for r in got} == pytest.approx(want, rel=1e-9)


def test_density_work_does_not_grow_with_scores(spark):
    import random

    draw = random.Random(1)
    some = spark.createDataFrame([(draw.random() ** 2, i % 2) for i in range(20_000)], SAMPLE)
    cells = K.similarity_kde(some, grid=21)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in cells and K.similarity_kde(some, grid=21).count() == 42
    one = spark.createDataFrame([(0.5, 0), (0.5, 0), (0.7, 1)], SAMPLE)
    assert K.similarity_kde(one).count() == 0 and K.similarity_kde(some.limit(0)).count() == 0


def test_shuffle_is_repeatable(spark):
    df = spark.range(200)
    one = [r.id for r in K.shuffle(df, ["id"], 1).collect()]
    assert one == [r.id for r in K.shuffle(df.repartition(7), ["id"], 1).collect()]
    assert one != [r.id for r in K.shuffle(df, ["id"], 2).collect()] and sorted(one) == list(range(200))


def test_places(spark):
    df = spark.range(1000).repartition(7)
    ordered = K.shuffle(df, ["id"], 3)
    got = sorted((r.place, r.id) for r in K.with_places(ordered).collect())
    assert [p for p, _ in got] == list(range(1, 1001)) and [i for _, i in got] == [r.id for r in ordered.collect()]
    assert K.with_places(df.limit(0)).count() == 0
