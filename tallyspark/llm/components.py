"""Connected components of a graph given by its edges.

Large-star and small-star steps in turn: each node's larger neighbours, then its
smaller ones, are joined to the least node known around it. Stars hang every
node directly under the least node of its component after a few rounds. Every
step is a grouping reduced before the shuffle and a join that AQE can split, and
its edges are written to the shared folder, so the lineage stays short. Only a
count and a sum of hashes come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(others).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of `edges` (columns a and b, whole numbers, not null)."""
    edges = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _mark(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    least = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        least.select("node", F.col("node").alias("component"))
    )


def spanning_forest(linked: np.ndarray, homes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the true cells of a matrix join: every row and column to the root of its tree."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not rows.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = linked[np.ix_(rows, columns)]
    names = np.arange(rows.size)
    while True:
        of_columns = np.where(part, names[:, None], rows.size).min(axis=0)
        again = np.where(part, of_columns[None, :], rows.size).min(axis=1)
        if (again == names).all():
            break
        names = again
    roots = homes[rows]
    return np.concatenate([roots, others[columns]]), np.concatenate([roots[names], roots[of_columns]])
