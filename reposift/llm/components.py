"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import staged


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components of links between ``a`` and ``b`` inside one task: nodes in order, the places of a and b, the place of each node's root."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(root[left], root[right]), root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, left, right, root
        root = new


def _smallest(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; sums map-side, so a hub costs one row per task."""
    return staged(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "smallest")


def _large_star(links: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest one."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_smallest(both), "u")
    return met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them; links point from the larger to the smaller."""
    met = links.join(_smallest(links), "u")
    return (
        met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(met.select("u", F.col("m").alias("v")))
        .where("u <> v").distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the graph whose links are rows of two 64-bit node ids ``u`` and ``v``.

    Returns ``node, root``: every node of a link between two different nodes
    and the smallest node of its component.  Rows with a null, repeated rows
    and loops change nothing; no link gives no row.  A hub is a skewed join
    key, which AQE splits, and never a collected list.  The number of rounds
    grows with the logarithm of the number of nodes.
    """
    links = staged(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        links = staged(_small_star(staged(_large_star(links), "large-star")), "small-star")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
