"""The labelling job: merge earlier labels, classify the rest in batches, write."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift import defaults
from reposift.operators.cascade import Classifier, cascade, final_labels
from reposift.operators.pairs import is_labelled, merge_progress, unlabelled
from reposift.operators.validation import require_positive
from reposift.session import cut_lineage, work_path
from reposift.sinks.pair_tables import write_labelled_pairs, write_with_fallback
from reposift.sources.pairs import PAIR_KEY


_BATCH = "label_batch"
BATCH_ROWS = 100_000


class ClassificationStopped(RuntimeError):
    """A classifier failed; the batches before it are written."""


@dataclass(frozen=True)
class LabelReport:
    output_path: str
    processed: int
    skipped: int


def batch_of(batches: int) -> Column:
    """Share of a pair by the MD5 of its key, which other engines can repeat."""
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in PAIR_KEY]))
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(batches)).cast("int")


def _labels_so_far(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def label_in_batches(
    pairs: DataFrame,
    label_path: str,
    first: Classifier,
    second: Classifier,
    batches: int | None = None,
    on_error: str = "raise",
    minimum: float = defaults.CLASSIFY_MIN_COSINE,
) -> None:
    """Append labels to ``label_path`` batch by batch.

    A batch is a share of the pair keys by hash and is appended whole or not
    at all.  A rerun after a failure only classifies pairs without a label.
    The open pairs are staged once, partitioned by batch, so a batch reads its
    own share and nothing else.  Unless stated, there is a batch for every
    BATCH_ROWS open pairs.
    """
    spark = pairs.sparkSession
    todo = unlabelled(pairs, _labels_so_far(spark, label_path))
    batches = math.ceil(todo.count() / BATCH_ROWS) or 1 if batches is None else batches
    require_positive(batches=batches)
    staged = work_path(spark, "to-label")
    todo.withColumn(_BATCH, batch_of(batches)).hint("rebalance", F.col(_BATCH)).write.partitionBy(_BATCH).parquet(staged)
    stored = T.StructType([*todo.schema.fields, T.StructField(_BATCH, T.IntegerType())])
    for batch in range(batches):
        share = spark.read.schema(stored).parquet(staged).filter(F.col(_BATCH) == batch).drop(_BATCH)
        try:
            labels = final_labels(cascade(share, first, second, minimum, on_error))
            labels.select(*PAIR_KEY, "cosine_similarity", "is_duplicate", "final_confidence").write.mode("append").parquet(label_path)
        except Exception as exc:
            raise ClassificationStopped(f"batch {batch} of {batches}: {type(exc).__name__}") from exc


def label_pairs_job(
    spark: SparkSession,
    pairs_path: str,
    label_path: str,
    output_path: str,
    fallback_path: str,
    first: Classifier,
    second: Classifier,
    *,
    earlier_path: str | None = None,
    batches: int | None = None,
    on_error: str = "raise",
) -> LabelReport:
    """Label a stored table of scored pairs and write it as CSV with all its rows."""
    table = spark.read.parquet(pairs_path)
    earlier = _labels_so_far(spark, earlier_path) if earlier_path else None
    merged = cut_lineage(table if earlier is None else merge_progress(table, earlier))
    todo = unlabelled(merged)
    label_in_batches(todo, label_path, first, second, batches, on_error)

    fresh = spark.read.parquet(label_path).select(*PAIR_KEY, F.col("is_duplicate").cast("string").alias("is_duplicate"), "final_confidence")
    result = merge_progress(merged, fresh) if "is_duplicate" in merged.columns else table.join(fresh, PAIR_KEY, "left")
    result = cut_lineage(result)  # written and counted
    used = write_with_fallback(lambda path: write_labelled_pairs(result, path), output_path, fallback_path)
    totals = result.join(todo.select(*PAIR_KEY).withColumn("asked", F.lit(1)), PAIR_KEY, "left").agg(
        F.count_if(F.col("asked").isNotNull() & is_labelled(F.col("is_duplicate"))).alias("processed"),
        F.count_if(F.col("asked").isNull()).alias("skipped")).first()
    return LabelReport(used, totals["processed"], totals["skipped"])
