"""The shape of physical plans: what scale depends on."""

import pytest

from catalog.inputs import view
from reposift.operators import pairs as P
from reposift.operators import reviewers as R
from reposift.operators.embedding import embed_texts
from reposift.sources.issues import cap_per_repo

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module", ["vectors", "reviewers", "pairs", "calibration"])
def test_no_cross_joins(spark, module):
    from importlib import import_module

    queries = import_module(f"catalog.{module}").QUERIES
    lazy = {"vectors": ["knn_topk", "duplicate_decision"], "pairs": ["repo_pairs", "merge_progress", "resume_antijoin"],
            "reviewers": ["direct_file_owners", "nearest_dir_fallback", "candidate_scores", "recommend_reviewers"],
            "calibration": ["pr_curve", "similarity_histogram", "similarity_kde"]}[module]
    for name in lazy:
        text = plan(queries[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_rank_limits_before_the_shuffle(spark):
    text = plan(cap_per_repo(view(spark, FOLDER, "issues").drop("body"), 50))
    assert text.count("WindowGroupLimit") == 2


def test_pairs_need_no_further_shuffle(spark):
    text = plan(P.repo_pairs(view(spark, FOLDER, "issues"), 50))
    assert text.count("hashpartitioning(repo") <= 2


def test_sums_are_combined_before_the_shuffle(spark):
    from catalog.reviewers import AS_OF

    assert "partial_sum" in plan(R.file_ownership(view(spark, FOLDER, "commits"), AS_OF))


def test_only_needed_columns_are_read(spark):
    text = plan(R.valid_commits(R.with_commit_defaults(view(spark, FOLDER, "commits"))).select("author", "weight"))
    assert "l_comment" not in text and "l_extendedprice" not in text and "PushedFilters: [IsNotNull(l_partkey)" in text


def test_model_runs_once(spark):
    from pyspark.sql import functions as F

    good, _ = embed_texts(view(spark, FOLDER, "issues"), "body")
    text = plan(good.select("issue_number", F.explode("embedding").alias("x")).filter("x > 0"))
    assert text.count("ArrowEvalPython") == 1
