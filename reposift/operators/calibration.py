"""Similarity distributions, precision-recall curve and the best threshold.

``sample(similarity DOUBLE, is_duplicate INT)`` is the input throughout.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reposift import defaults
from reposift.functions.vectors import f1
from reposift.operators.validation import require_positive
from reposift.session import cut_lineage

#: Distinct scores of one range, which one task puts into order.
CURVE_ROWS = 20_000


def label_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Two samples of ``similarity`` as one labelled table."""
    return positives.withColumn("is_duplicate", F.lit(1)).unionByName(negatives.withColumn("is_duplicate", F.lit(0)))


def shuffle(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Random order that depends on the seed and the keys, not on the partitioning.

    Unlike a generator per partition this gives the same order again when a
    lost task is repeated.
    """
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")), *keys)


def with_places(ordered: DataFrame) -> DataFrame:
    """Ordered rows with their ``place`` from 1; each task counts its own rows and only counts per task are added up."""
    rows = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_task": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("n")).select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(tasks, "_task").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_task", "_before", "_at")


def head(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    require_positive(n=n)
    return df.orderBy(*order).limit(n)


def score_counts(sample: DataFrame) -> DataFrame:
    """Positives and rows per distinct score: the only pass over the whole sample."""
    return sample.groupBy("similarity").agg(
        F.sum(F.col("is_duplicate").cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("rows"))


def pr_curve(sample: DataFrame, buckets: int | None = None) -> DataFrame:
    """Precision, recall and F1 for every distinct score taken as threshold.

    A row is predicted positive when its score reaches the threshold.  Running
    sums are taken in two levels: scores are cut into ``buckets`` ranges of
    about equal size, the sums of whole ranges (at most ``buckets`` rows) give
    each range its starting point, and only rows of one range are ordered in
    one task.  Unless stated, the number of ranges follows the number of
    distinct scores.
    """
    counts = cut_lineage(score_counts(sample))
    buckets = counts.count() // CURVE_ROWS + 1 if buckets is None else buckets
    require_positive(buckets=buckets)
    shares = [i / buckets for i in range(1, buckets)]
    # at most `buckets` numbers reach the driver
    cuts = sorted(set(counts.approxQuantile("similarity", shares, 0.1 / buckets))) if shares else []
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        placed = Bucketizer(splits=splits, inputCol="similarity", outputCol="bucket").transform(counts)
    else:
        placed = counts.withColumn("bucket", F.lit(0.0))
    totals = placed.groupBy("bucket").agg(F.sum("positives").alias("p"), F.sum("rows").alias("n"))
    higher = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "bucket",
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("p_before"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_before"),
        F.sum("p").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("p_all"),
    )
    down = Window.partitionBy("bucket").orderBy(F.desc("similarity")).rowsBetween(Window.unboundedPreceding, 0)
    hits = F.col("p_before") + F.sum("positives").over(down)
    taken = F.col("n_before") + F.sum("rows").over(down)
    curve = placed.join(F.broadcast(starts), "bucket").select(
        F.col("similarity").alias("threshold"), hits.alias("tp"), taken.alias("predicted"), "p_all")
    return with_f1(curve.select(
        "threshold",
        (F.col("tp") / F.col("predicted")).alias("precision"),
        F.when(F.col("p_all") > 0, F.col("tp") / F.col("p_all")).otherwise(F.lit(1.0)).alias("recall"),
    ))


def with_f1(curve: DataFrame) -> DataFrame:
    return curve.withColumn("f1", f1(F.col("precision"), F.col("recall"), defaults.F1_EPSILON))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the highest F1, the lowest threshold among equals; no global sort."""
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(F.col("f1"), -F.col("threshold")))
    return curve.agg(best.alias("best")).filter("best IS NOT NULL").select("best.*")


def _label_stats(sample: DataFrame) -> DataFrame:
    """One row per label with the range of the whole sample; joined back by label."""
    per_label = sample.groupBy("is_duplicate").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("similarity").alias("sd"),
        F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    whole = Window.partitionBy(F.lit(1))
    return per_label.select(
        "is_duplicate", "n", "sd", F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"),
        F.sum("n").over(whole).alias("n_all"))


def similarity_histogram(sample: DataFrame, bins: int = defaults.HISTOGRAM_BINS) -> DataFrame:
    """Counts per label in ``bins`` equal bins over the common range; the last bin is closed."""
    require_positive(bins=bins)
    stats = _label_stats(sample).select("is_duplicate", "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.floor((F.col("similarity") - F.col("lo")) / width)).otherwise(F.lit(0))
    return (
        sample.join(stats, "is_duplicate")
        .withColumn("bin", F.least(at, F.lit(bins - 1)).cast("bigint"))
        .groupBy("is_duplicate", "bin")
        .agg(F.count(F.lit(1)).alias("rows"), F.first(F.col("lo") + F.col("bin") * width).alias("left_edge"))
    )


#: Part of a grid step that tests allow a density to be off by; the sum itself takes every score as it is.
KDE_CELLS = 16


def similarity_kde(sample: DataFrame, grid: int = defaults.KDE_GRID, common_norm: bool = True) -> DataFrame:
    """Gaussian density per label on ``grid`` points over the common range, a row per label and point.

    Bandwidth is ``stddev_samp * n^(-1/5)``.  Equal scores are counted first;
    each distinct score then adds its kernel to every grid point inside its
    task, and only ``grid`` sums per label and task are shuffled.  With
    ``common_norm`` the areas of the labels add up to one.  Labels of one
    score, or of equal ones, have no row.
    """
    require_positive(grid=grid)
    stats = _label_stats(sample).filter("sd > 0")
    weights = sample.groupBy("is_duplicate", "similarity").agg(F.count(F.lit(1)).alias("weight"))
    step = (F.col("hi") - F.col("lo")) / max(grid - 1, 1)
    x = F.col("lo") + F.col("point") * step
    bandwidth = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    z = (x - F.col("similarity")) / bandwidth
    mass = F.col("n_all") if common_norm else F.col("n")
    kernel = F.col("weight") * F.exp(F.lit(-0.5) * z * z) / (mass * bandwidth * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        weights.join(stats, "is_duplicate")
        .withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))))
        .groupBy("is_duplicate", "point")
        .agg(F.first(x).alias("x"), F.sum(kernel).alias("density"))
    )
