"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import cover_tree
from tallyspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row int, score string, `group` int, vector string"


def plain(rows, scale=256, anchor=lambda i: i is not None and i % 100 == 0, low=80, high=100, k=5):
    taking = []
    for i, vector, label in rows:
        if vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taking.append((i, [math.floor(float(np.float32(x)) * scale) for x in vector], label))
    width = max((len(v) for _, v, _ in taking), default=0)
    taking = [(i, v + [0] * (width - len(v)), label) for i, v, label in taking]
    by_id = lambda i: (i is None, i or 0)
    out = []
    for a in [t for t in taking if anchor(t[0])]:
        score = lambda t: sum(x * y for x, y in zip(a[1], t[1]))  # noqa: B023, E731
        same = sorted([(-score(t), by_id(t[0]), t[0]) for t in taking if t is not a and t[2] == a[2]])[:k]
        other = sorted([(-score(t), by_id(t[0]), t[0]) for t in taking if t[2] != a[2]])
        for minus, _, positive in same:
            s = -minus
            fits = [(t, i) for t, _, i in other if low * s <= -100 * t <= high * s][:k]
            out += [(a[0], positive, rank, i, s, -t) for rank, (t, i) in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "s", 2, "v") for r in rows], SCHEMA)
    taking = cover_tree.taking_part(table, 256, "vec_id", "embedding", F.col("label"))
    return sorted([tuple(r) for r in cover_tree.mine(taking, F.col("id") % 100 == 0, **options).collect()], key=str)


def test_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in QUERIES["op12_hard_negatives"](spark, folder).collect()], key=str) == plain(rows)


@pytest.mark.parametrize("kind", ["structured", "copies"])
def test_several_groups_blocks_and_trees(spark, monkeypatch, kind):
    draw = np.random.default_rng(3)
    monkeypatch.setattr(cover_tree, "TREE_ROWS", 90)
    monkeypatch.setattr(cover_tree, "LEAST_ROWS", 100)
    monkeypatch.setattr(cover_tree, "MOST_ROWS", 200)
    monkeypatch.setattr(cover_tree, "BLOCK", 3)
    monkeypatch.setattr(cover_tree, "WIDTH", 4)
    monkeypatch.setattr(cover_tree, "LEAF", 5)
    centres = draw.normal(size=(9, 8))
    points = centres[draw.integers(0, 9, 500)] + 0.1 * draw.normal(size=(500, 8))
    if kind == "copies":
        points[:200] = points[0]
        points *= draw.choice([0.5, 1, 40], size=(500, 1))
    rows = [(i, [float(x) for x in p], int(draw.integers(0, 4))) for i, p in enumerate(points)]
    assert mined(spark, rows) == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, None, 1), (200, [0.5, None], 1), (300, [nan, 1.0], 2), (400, [inf, 1.0], 2),
        (500, [0.0, 0.0], 2), (600, [1.0, 1.0], None), (None, [1.0, 0.5], 1), (None, [0.9, 0.5], 2), (700, [-1.0, -1.0], 3),
        (800, [], 4), (1, [1.0, 0.45], 2), (2, [1.0, 0.45], 2), (3, [0.95], 3), (900, [3e9, 1.0], 5), (4, [1.0, 0.5], 1),
    ]
    shown = [(i, [min(x, cover_tree.GREATEST / 256) if x is not None and math.isfinite(x) else x for x in v] if v is not None else v, label) for i, v, label in rows]
    assert mined(spark, rows) == plain(shown)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_bounds_skip_nodes(spark, monkeypatch):
    """On clustered vectors a descent compares few points, and finds what a full comparison finds."""
    draw = np.random.default_rng(4)
    points = np.floor(256 * (np.repeat(draw.normal(size=(40, 16)), 50, axis=0) + 0.02 * draw.normal(size=(2000, 16)))).astype(np.int64)
    tree = cover_tree.Tree(points)
    compared = []
    real = cover_tree.runs
    monkeypatch.setattr(cover_tree, "runs", lambda a, b: (compared.append(int((b - a).sum())), real(a, b))[1])
    allowed = [np.ones(2000, dtype=bool)]
    for anchor in points[::200]:
        score = points @ anchor
        want = sorted(zip((-score).tolist(), range(2000)))[:5]
        assert [(-s, j) for _, j, s in cover_tree.best_of([tree], [np.arange(2000)], allowed, anchor, 5, cover_tree.NEVER, -cover_tree.NEVER)] == want
    assert sum(compared) / 10 < 1000
    assert sorted(tree.order.tolist()) == list(range(2000))
