"""Pair tables: candidates, scored pairs and earlier labels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.operators.validation import has_columns

PAIR_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("issue_1_number", T.LongType()),
    T.StructField("issue_1_text", T.StringType()),
    T.StructField("issue_2_number", T.LongType()),
    T.StructField("issue_2_text", T.StringType()),
    T.StructField("is_duplicate", T.StringType()),
])
SCORED_SCHEMA = T.StructType(
    PAIR_SCHEMA.fields[:5] + [T.StructField("cosine_similarity", T.DoubleType()), PAIR_SCHEMA.fields[5],
                              T.StructField("final_confidence", T.DoubleType())]
)
PROGRESS_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("issue_1_number", T.LongType()),
    T.StructField("issue_2_number", T.LongType()),
    T.StructField("is_duplicate", T.StringType()),
    T.StructField("final_confidence", T.DoubleType()),
])
PAIR_KEY = ["repo", "issue_1_number", "issue_2_number"]


def csv_reader(spark: SparkSession):
    """Header line, quoted texts that may span lines, quotes doubled inside quotes.

    A multi-line CSV file can't be split between tasks: use CSV at the edges
    only, with many files, and Parquet between jobs.
    """
    return (
        spark.read.option("header", True).option("multiLine", True)
        .option("escape", '"').option("quote", '"').option("lineSep", "\n")
    )


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    return csv_reader(spark).schema(schema).csv(path)


def _open(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    try:
        return csv_reader(spark).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    except AnalysisException:
        return None


def read_progress(spark: SparkSession, primary: str, fallback: str, fmt: str = "parquet") -> DataFrame:
    """Earlier labels from the first of the two paths that exists.

    No path, or a table that lacks a key or label column, gives an empty table.
    """
    found = _open(spark, primary, fmt)
    if found is None:
        found = _open(spark, fallback, fmt)
    if found is None or not has_columns(found, PROGRESS_SCHEMA.names):
        return spark.createDataFrame([], PROGRESS_SCHEMA)
    return found.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in PROGRESS_SCHEMA.fields])
