"""Score distributions and the duplicate threshold, on the scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import with_views
from catalog.pairs import scored
from reposift.operators import calibration as K


def sample(spark, folder):
    return scored(spark, folder).select(
        F.col("cosine_similarity").alias("similarity"), F.col("true_label").alias("is_duplicate"))


def label_union(spark, folder):
    rows = sample(spark, folder)
    one = rows.filter("is_duplicate = 1").select("similarity")
    zero = rows.filter("is_duplicate = 0").select("similarity")
    return K.label_union(one, zero)


def shuffle(spark, folder):
    """The order is compared as each row's place in it."""
    keys = ["repo", "issue_1_number", "issue_2_number"]
    return K.with_places(K.shuffle(scored(spark, folder), keys)).select("place", *keys)


def head(spark, folder):
    keys = ["repo", "issue_1_number", "issue_2_number"]
    return K.head(scored(spark, folder), [F.desc("cosine_similarity"), *keys]).select(*keys, "cosine_similarity")


def similarity_histogram(spark, folder):
    return K.similarity_histogram(sample(spark, folder)).withColumn("left_edge", F.round("left_edge", 9))


def similarity_kde(spark, folder):
    return K.similarity_kde(sample(spark, folder)).withColumns(
        {"x": F.round("x", 9), "density": F.round("density", 6)})


def pr_curve(spark, folder):
    return K.pr_curve(sample(spark, folder), buckets=16).select(
        "threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def best_threshold(spark, folder):
    return K.best_threshold(K.pr_curve(sample(spark, folder))).select(
        "threshold", *[F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")])


QUERIES = {f.__name__: f for f in (
    label_union, shuffle, head, similarity_histogram, similarity_kde, pr_curve, best_threshold)}

_CURVE = """+c as (select cosine_similarity as s, sum(true_label) as p, count(*) as n from scored_pairs group by 1),
    r as (select s, sum(p) over w as tp, sum(n) over w as taken, sum(p) over () as p_all from c
          window w as (order by s desc rows unbounded preceding)),
    q as (select s as threshold, tp / taken as precision, case when p_all > 0 then tp / p_all else 1 end as recall from r),
    curve as (select *, 2 * (precision * recall) / (precision + recall + cast(1e-10 as double)) as f1 from q)"""
_STATS = """+st as (select true_label, count(*) as n, stddev_samp(cosine_similarity) as sd from scored_pairs group by 1),
    rg as (select min(cosine_similarity) as lo, max(cosine_similarity) as hi, count(*) as n_all from scored_pairs)"""

SQL = {
    "label_union": with_views("scored_pairs", "select cosine_similarity as similarity, true_label as is_duplicate from scored_pairs"),
    "shuffle": with_views("scored_pairs", """select place, repo, issue_1_number, issue_2_number from (
        select *, row_number() over (order by md5(concat_ws('|', '42', repo, issue_1_number, issue_2_number)), repo, issue_1_number, issue_2_number) as place
        from scored_pairs)"""),
    "head": with_views("scored_pairs", """select repo, issue_1_number, issue_2_number, cosine_similarity from scored_pairs
        order by cosine_similarity desc, repo, issue_1_number, issue_2_number limit 5"""),
    "similarity_histogram": with_views("scored_pairs", _STATS + """
        select true_label as is_duplicate, bin, count(*) as "rows", round(lo + bin * ((hi - lo) / 50), 9) as left_edge
        from (select true_label, lo, hi, cast(least(floor((cosine_similarity - lo) / ((hi - lo) / 50)), 49) as bigint) as bin
              from scored_pairs, rg) group by all"""),
    "similarity_kde": with_views("scored_pairs", _STATS + """,
        g as (select i as point, lo + i * ((hi - lo) / 199) as x, n_all from rg, (select unnest(range(0, 200)) as i))
        select s.true_label as is_duplicate, g.point, round(any_value(g.x), 9) as x,
               round(sum(exp(cast(-0.5 as double) * pow((g.x - s.cosine_similarity) / (st.sd * pow(st.n, cast(-0.2 as double))), 2))
                     / (g.n_all * st.sd * pow(st.n, cast(-0.2 as double)) * sqrt(2 * pi()))), 6) as density
        from scored_pairs s join st on s.true_label = st.true_label, g group by all"""),
    "pr_curve": with_views("scored_pairs", _CURVE + """
        select threshold, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from curve"""),
    "best_threshold": with_views("scored_pairs", _CURVE + """
        select threshold, round(f1, 9) as f1, round(precision, 9) as precision, round(recall, 9) as recall
        from curve order by curve.f1 desc, threshold limit 1"""),
}
