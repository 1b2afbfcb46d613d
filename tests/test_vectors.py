"""Vector matching against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tallyspark.operators import vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    stored = np.vstack([centres[i % 6] + 0.15 * rng.normal(size=16) for i in range(240)])
    stored[100:180] = stored[100]  # a third of all vectors are copies
    catalogue = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(stored)], "vec_id long, embedding array<float>"
    )
    queries = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "query_id long, query array<double>")
    v32 = stored.astype(np.float32).astype(np.float64)
    sims = (centres / np.linalg.norm(centres, axis=1)[:, None]) @ (v32 / np.linalg.norm(v32, axis=1)[:, None]).T
    sims = np.floor(sims * 1e6 + 0.5) / 1e6
    best = {q: [int(i) for i in np.lexsort((np.arange(240), -sims[q]))[:8]] for q in range(6)}
    return catalogue, queries, best


def ranks(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


@pytest.mark.parametrize("max_queries", [100, 2])
def test_exact_equals_brute_force(data, max_queries):
    catalogue, queries, best = data
    assert ranks(vectors.nearest_exact(queries, catalogue, 8, max_queries)) == best


def test_approximate_recall(data):
    catalogue, queries, best = data
    got = ranks(vectors.nearest_approximate(queries, catalogue, 8))
    hits = sum(len(set(got.get(q, [])) & set(ids)) for q, ids in best.items())
    assert hits / sum(map(len, best.values())) >= 0.9


def test_exact_takes_empty_tables_and_many_blocks(data):
    catalogue, queries, best = data
    assert vectors.nearest_exact(queries.limit(0), catalogue, 8).collect() == []
    assert vectors.nearest_exact(queries, catalogue.limit(0), 8).collect() == []
    found = vectors.nearest_exact(queries, catalogue, 300, 1)
    assert found.count() == 6 * 240
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
