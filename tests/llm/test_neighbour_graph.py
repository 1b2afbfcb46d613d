"""Approximate neighbours: recall against brute force, exact scores, and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import neighbour_graph

SCHEMA = "vec_id long, embedding array<double>, node int, others string, part int"


def found(spark, rows, k=20):
    table = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA)
    return neighbour_graph.nearest(table, F.col("id") % 20 == 0, k).collect()


def recall(result, ids, points, k=20):
    by_query = {}
    for r in result:
        by_query.setdefault(r["query_id"], []).append(r)
    hits = wanted = 0
    for q in range(len(ids)):
        if ids[q] % 20:
            continue
        score = points @ points[q]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        rows = sorted(by_query[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert [r["score"] for r in rows] == sorted([r["score"] for r in rows], reverse=True)
        at = {int(i): j for j, i in enumerate(ids)}
        np.testing.assert_allclose([r["score"] for r in rows], [score[at[r["vec_id"]]] for r in rows], rtol=1e-12)
        hits += len({int(ids[j]) for j in best} & {r["vec_id"] for r in rows})
        wanted += len(best)
    return hits / wanted


@pytest.mark.parametrize("kind", ["even", "lengths", "copies"])
def test_recall(spark, monkeypatch, kind):
    draw = np.random.default_rng(7)
    monkeypatch.setattr(neighbour_graph, "LEAST_PARTS", 6)
    points = draw.normal(size=(3000, 32))
    if kind == "lengths":
        points *= draw.uniform(0.1, 3, size=(3000, 1))
    if kind == "copies":
        points[1000:2000] = points[0]
        points[2000:2400] = points[1] + 1e-3 * draw.normal(size=(400, 32))
    ids = draw.permutation(3000)
    result = found(spark, [(int(i), [float(x) for x in p]) for i, p in zip(ids, points)])
    assert recall(result, ids, points) >= 0.9


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas()
    ids, points = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), dtype=np.float64)
    assert recall(neighbour_graph.nearest(rows, F.col("id") % 20 == 0).collect(), ids, points) >= 0.95


def test_edges(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [None, 1.0]),
        (None, [0.5, 0.5]), (2, [0.5]), (100, [-1.0, 2.0]), (3, [float("inf"), 1.0]),
    ]
    got = sorted([(r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"], r["score"]) for r in found(spark, rows, 3)])
    of_zero = [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5)]
    assert got == sorted(of_zero * 2 + [(100, 1, -1, 0.5), (100, 2, 2, -0.5), (100, 3, 0, -1.0)])
    assert found(spark, rows[:1]) == [] and found(spark, rows[3:4]) == [] and found(spark, []) == []
    assert [tuple(r) for r in found(spark, [(20, [1.0]), (21, [2.0])])] == [(20, 1, 21, 2.0)]
