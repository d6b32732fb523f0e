import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from catalog.pairs import first_scorer, second_scorer
from reposift.operators import cascade as C
from reposift.plans import labelling

PAIRS = "repo string, issue_1_number long, issue_2_number long, cosine_similarity double"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("r", i, i + 1 + i % 3, (i % 100) / 100) for i in range(400)], PAIRS).cache()


@pytest.mark.parametrize("duplicate, confidence, review, wanted", [
    (True, 0.90, False, False), (True, 0.89, False, True), (False, 0.85, False, False), (False, 0.84, False, True),
    (False, None, False, True), (True, 1.0, True, True), (None, 0.85, None, False),
])
def test_second_check(spark, duplicate, confidence, review, wanted):
    df = spark.createDataFrame([(duplicate, confidence, review)], "d boolean, c double, r boolean")
    assert df.select(C.second_check_needed(F.col("d"), F.col("c"), F.col("r")).alias("x")).first().x is wanted


def test_branches_add_up(pairs):
    out = C.cascade(pairs, first_scorer, second_scorer).collect()
    assert len(out) == 400 and len({(r.issue_1_number, r.issue_2_number) for r in out}) == 400
    for r in out:
        if r.cosine_similarity < 0.40:
            assert (r.is_duplicate, r.confidence, r.duplicate_type, r.pass_1_is_duplicate) == (False, 1.0, "not_duplicate", None)
        elif r.second_check_ran:
            assert r.reason == "second" and r.needs_review is False and r.verifier_reason == "second" and r.pass_1_reason == "first"
            assert r.verifier_agree_with_first_pass == (r.pass_1_is_duplicate == r.is_duplicate)
        else:
            assert r.reason == "first" and r.confidence == r.pass_1_confidence and r.verifier_final_route is None


def test_each_pair_is_classified_once(spark, pairs):
    calls = spark.sparkContext.accumulator(0)

    def counting(pdf):
        import pandas as pd

        calls.add(len(pdf))
        return pd.DataFrame({"is_duplicate": True, "confidence": 0.5, "needs_review": False, "duplicate_type": "same_bug",
                             "reason": "r", "matching_signals": [[]] * len(pdf), "difference_signals": [[]] * len(pdf)})

    out = C.cascade(pairs, C.pandas_classifier(counting, C.FIRST_RESULT), second_scorer)
    assert out.count() == 400 and calls.value == pairs.filter("cosine_similarity >= 0.4").count()


def test_failed_rows_are_kept_apart(pairs):
    def local(pdf):
        import pandas as pd

        if (pdf["issue_1_number"] % 50 == 49).any():
            raise ValueError("no answer")
        return pd.DataFrame({"is_duplicate": False, "confidence": 0.99, "needs_review": False, "duplicate_type": "not_duplicate",
                             "reason": "r", "matching_signals": [[]] * len(pdf), "difference_signals": [[]] * len(pdf)})

    first = C.pandas_classifier(local, C.FIRST_RESULT, on_error="review")
    out = C.cascade(pairs, first, second_scorer, on_error="review")
    failed = out.filter("error IS NOT NULL").collect()
    assert {r.issue_1_number % 100 for r in failed} == {49, 99} and out.count() == 400
    assert all((r.is_duplicate, r.confidence, r.duplicate_type, r.verifier_final_route) == (None, 0.0, "unclear", "manual_review") for r in failed)
    assert C.final_labels(out).count() == 400 - len(failed)
    with pytest.raises((PySparkException, Py4JJavaError)):
        C.cascade(pairs, C.pandas_classifier(local, C.FIRST_RESULT), second_scorer).count()


def test_answers_out_of_range_are_errors(pairs):
    odd = lambda df: first_scorer(df).withColumn("confidence", F.lit(1.5))
    assert C.cascade(pairs, odd, second_scorer, on_error="review").filter("error = 'invalid confidence'").count() == 240
    with pytest.raises((PySparkException, Py4JJavaError)):
        C.cascade(pairs, odd, second_scorer)


def test_resume_equals_one_run(spark, pairs, work):
    whole, parts = work(), work()
    labelling.label_in_batches(pairs, whole, first_scorer, second_scorer, batches=2)
    labelling.label_in_batches(pairs.filter("issue_1_number < 150"), parts, first_scorer, second_scorer, batches=2)
    labelling.label_in_batches(pairs, parts, first_scorer, second_scorer, batches=3)
    rows = lambda path: sorted(map(tuple, spark.read.parquet(path).collect()))
    assert rows(whole) == rows(parts) and len(rows(whole)) == 400


def test_job_without_labels(spark, pairs, work):
    source = work()
    pairs.write.parquet(source)
    report = labelling.label_pairs_job(spark, source, work(), work(), work(), first_scorer, second_scorer, batches=2)
    assert (report.processed, report.skipped) == (400, 0)
