"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.session import work_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a read and no recomputation,
    and gives Spark exact sizes, on which it decides whether to broadcast.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: 192 bits that tell rows apart by some of their columns, nulls included.
ROW_KEY = ("_key_1", "_key_2", "_key_3")


def row_key(*columns: str) -> dict[str, Column]:
    return {name: F.xxhash64(F.lit(name), *columns, *[F.col(c).isNull() for c in columns]) for name in ROW_KEY}


def one_per_key(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys(ROW_KEY, _rows, ...)``, once for each key, with the columns of ``keys``.

    ``_rows`` says how many rows have the key: only where there are several is
    anything more shuffled, after one row a task is left of them.  The list of
    keys grows with the documents, so the plan is a merge join at every size.
    """
    met = docs.join(keys.hint("merge"), list(ROW_KEY))
    return met.where("_rows = 1").unionByName(met.where("_rows > 1").dropDuplicates(list(ROW_KEY)))
