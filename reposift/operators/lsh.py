"""Approximate cosine neighbours by hash tables over random projections.

A table takes ``hashes`` projections x.r of the unit vector x, each cut into
steps of ``width`` at a random offset (Datar et al., 2004); vectors meet in a
table if all their steps are equal.  Directions are rows of random signs
(Achlioptas, 2003), drawn from MD5 so that any engine can repeat them.

Each vector is a row per table; buckets meet by an equi join and are split into
blocks of bounded size, so that a hot bucket is many tasks.  Block pairs are
multiplied inside Arrow batches: scores are exact and no pair but the best of
a block leaves a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift import defaults
from reposift.operators import neighbours as N
from reposift.operators.validation import require_positive
from reposift.session import cut_lineage


def signs(table: int, number: int, dimension: int) -> list[int]:
    """One direction: the sign of each component, from the first digit of an MD5."""
    return [1 if hashlib.md5(f"{table}|{number}|{i}".encode()).hexdigest()[0] < "8" else -1 for i in range(dimension)]


def offset(table: int, number: int) -> float:
    """Where the steps of a projection begin, as a part of their width."""
    return int(hashlib.md5(f"{table}|{number}".encode()).hexdigest()[:8], 16) / 2**32


def _buckets(tables: int, hashes: int, width: float):
    """Arrow function: a vector's bucket in every table, as text that begins with the table."""

    @F.pandas_udf("array<string>")
    def buckets(embedding):
        import numpy as np
        import pandas as pd

        if len(embedding) == 0:
            return pd.Series([], dtype=object)
        rows = np.stack(embedding.to_numpy()).astype("float64")
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        rows /= np.where(lengths > 0, lengths, 1.0)
        dimension = rows.shape[1]
        if dimension not in drawn:
            drawn[dimension] = np.array([signs(t, j, dimension) for t in range(tables) for j in range(hashes)]).T / np.sqrt(dimension)
        steps = np.floor(rows @ drawn[dimension] / width + begins).astype(int).reshape(len(rows), tables, hashes)
        return pd.Series([[f"{t}:" + ",".join(map(str, own)) for t, own in enumerate(row)] for row in steps.tolist()])

    drawn: dict = {}
    begins = [offset(t, j) for t in range(tables) for j in range(hashes)]
    return buckets.asNondeterministic()  # one evaluation, whatever is filtered later


def ann_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = defaults.KNN_LIMIT,
    *,
    tables: int,
    hashes: int,
    width: float,
    exclude_self: bool = False,
    min_similarity: float | None = None,
    block_rows: int = N.BLOCK_ROWS,
) -> DataFrame:
    """Approximate :func:`reposift.operators.neighbours.knn_topk`: the best among vectors that share a bucket with the query.

    More ``tables`` find more, more ``hashes`` or a smaller ``width`` compare
    less; a query gets fewer than ``k`` matches where fewer share a bucket.
    The plan is the same at every size and scores are exact.
    """
    require_positive(k=k, tables=tables, hashes=hashes, width=width, block_rows=block_rows)
    asked, known = N._prepare(queries, vectors)

    def placed(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.withColumn("cluster", F.explode(_buckets(tables, hashes, width)("embedding"))))

    held = placed(known)
    sizes = held.groupBy("repo_name", "cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    blocks = N._with_sub_block(held, sizes, "issue_number")
    if queries is vectors:
        homes = blocks.withColumnRenamed("issue_number", "query_number").drop("title")
    else:
        own = placed(asked)
        own_sizes = own.groupBy("repo_name", "cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
        homes = N._with_sub_block(own, own_sizes, "query_number")
    visits = homes.join(sizes, ["repo_name", "cluster"]).withColumns({
        "q_cluster": F.col("cluster"), "q_sub": F.col("sub"), "v_cluster": F.col("cluster"),
        "v_sub": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
    })
    met = N._multiply(visits, blocks, N._block_kernel(k, exclude_self, False))
    # a pair that meets in several tables has the same score in each
    found = N._rank(met.dropDuplicates(["repo_name", "query_number", "match_number"]), k)
    return found if min_similarity is None else found.filter(F.col("similarity_score") >= min_similarity)
