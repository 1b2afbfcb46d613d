"""Hard negatives: rows of another label that score nearly as high for an anchor as its positives do.

The score is the inner product of whole-number vectors. A further coordinate, the root of
the greatest squared norm less the own one, gives all candidates one norm; an anchor gets 0
there, which leaves its products as they are, and a ball of radius r around a centre then
holds products within |anchor| * r of the centre's. Candidates are dealt to groups, and each
group builds cover trees over these vectors: the children of a node are a net of its points
with a radius smaller by `BASE`, each centre farther from the others than that, the node's
own centre among them. A node keeps the covering radius of its own points, so bounds get
tighter level by level.

Anchors descend best-first, from the nodes with the greatest upper bound. A node whose
bounds miss the wanted window, or whose upper bound is below the k-th score found, is left
out with all below it; points of leaves are compared exactly, in integers. First the best rows of
the same label are found (positives), then for each positive the best rows of other labels
with a score between two percentages of the positive's.

Anchors go to the groups in blocks, so a task holds one group and one block. Groups hold
rows by a hash, so no label, copy or value makes one large; their number grows with the root
of the rows and, above `MOST_ROWS` a group, with the rows. A group returns k rows an anchor.

Rows without label or vector, or with null or not finite components, take no part. Missing
components of shorter vectors count as 0. Components beyond 2**26 are taken as 2**26, so that
sums stay exact up to 1024 components. Rows are told apart by themselves, not by ids: repeated ids are rows of their own,
null ids are smallest last and come back as null. Ties go to the smaller id. Fewer rows than
asked for give fewer, an empty table an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import stored

BASE = 1.3
LEAF = 32
TREE_ROWS = 4096
LEAST_ROWS, MOST_ROWS = 1024, 65_536  # of a group
BLOCK = 8192  # anchors
WIDTH = 256  # nodes opened at a time
GREATEST = 1 << 26
NO_ID = (1 << 63) - 1
NEVER = -(1 << 62)


class Tree:
    """A cover tree. Every node covers a run of `order`; children of a node are a run of nodes."""

    def __init__(self, points: np.ndarray):
        self.points = points
        norms = (points.astype(np.float64) ** 2).sum(axis=1)
        lifted = np.column_stack([points, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float64)
        squares = (lifted**2).sum(axis=1)
        order = np.arange(len(points))
        centre, radius, low, high, child_low, child_high = [0], [0.0], [0], [len(points)], [0], [0]
        slack = 1e-7 * (1 + math.sqrt(float(squares.max())))

        def distances(rows: np.ndarray, to: int) -> np.ndarray:
            between = squares[rows] + squares[to] - 2 * (lifted[rows] @ lifted[to])
            return np.sqrt(np.maximum(between, 0)) + slack

        node = 0
        while node < len(centre):
            members = order[low[node] : high[node]].copy()
            far = distances(members, centre[node])
            radius[node] = float(far.max())
            if len(members) > LEAF and radius[node] > 2 * slack:
                within, rest, at = radius[node] / BASE, members, low[node]
                child_low[node] = len(centre)
                while len(rest):
                    to = centre[node] if at == low[node] else rest[0]
                    near = (distances(rest, to) <= within) | (rest == to)
                    own = rest[near]
                    order[at : at + len(own)] = own
                    for column, value in ((centre, int(to)), (radius, 0.0), (low, at), (high, at + len(own)), (child_low, 0), (child_high, 0)):
                        column.append(value)
                    at, rest = at + len(own), rest[~near]
                child_high[node] = len(centre)
            node += 1
        self.order = order
        self.centres = points[centre].astype(np.float64)
        self.radius, self.low, self.high, self.child_low, self.child_high = map(np.array, (radius, low, high, child_low, child_high))


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def best_of(trees: list[Tree], ids: list[np.ndarray], allowed: list[np.ndarray], anchor: np.ndarray, k: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """The k greatest (score, id) within the window, as (tree, row, score): greatest score first, ties to the smaller id."""
    length = math.sqrt(float((anchor.astype(np.float64) ** 2).sum()))
    as_float = anchor.astype(np.float64)
    found = np.zeros((0, 4), dtype=np.int64)  # score, id, tree, row
    tree_of, nodes, upper = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))

    def opened(t: int, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tree = trees[t]
        middle, reach = tree.centres[new] @ as_float, length * tree.radius[new] + 1e-6 * (1 + length)
        inside = (middle + reach >= low) & (middle - reach <= high)
        return new[inside], (middle + reach)[inside]

    start = [opened(t, np.array([0])) for t in range(len(trees))]
    tree_of = np.repeat(np.arange(len(trees)), [len(n) for n, _ in start])
    nodes, upper = np.concatenate([n for n, _ in start]), np.concatenate([u for _, u in start])
    while len(nodes):
        least = int(found[k - 1, 0]) if len(found) >= k else NEVER
        wanted = upper >= least
        tree_of, nodes, upper = tree_of[wanted], nodes[wanted], upper[wanted]
        if not len(nodes):
            break
        cut = np.argpartition(-upper, WIDTH - 1) if len(nodes) > WIDTH else np.arange(len(nodes))
        now, later = cut[:WIDTH], cut[WIDTH:]
        queue = [(tree_of[later], nodes[later], upper[later])]
        for t in np.unique(tree_of[now]).tolist():
            tree, own = trees[t], nodes[now][tree_of[now] == t]
            inner = tree.child_high[own] > tree.child_low[own]
            leaves = own[~inner]
            rows = tree.order[runs(tree.low[leaves], tree.high[leaves])]
            rows = rows[allowed[t][rows]]
            scores = tree.points[rows] @ anchor
            fits = (scores >= max(low, least)) & (scores <= high)
            rows, scores = rows[fits], scores[fits]
            if len(rows):
                found = np.concatenate([found, np.column_stack([scores, ids[t][rows], np.full(len(rows), t), rows])])
                found = found[np.lexsort((found[:, 1], -found[:, 0]))[:k]]
            if inner.any():
                children, bounds = opened(t, runs(tree.child_low[own[inner]], tree.child_high[own[inner]]))
                queue.append((np.full(len(children), t), children, bounds))
        tree_of, nodes, upper = (np.concatenate(parts) for parts in zip(*queue))
    return [(int(t), int(row), int(score)) for score, _, t, row in found]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of equal width."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def grown(rows: pa.Table, width: int) -> tuple[list[Tree], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The trees of a group with the row numbers, ids and labels of their points."""
    rows = rows.sort_by("row")
    points = matrix(rows["vector"], width)
    columns = [rows[c].to_numpy() for c in ("row", "id", "label")]
    cuts = range(0, len(points), TREE_ROWS)
    return [Tree(points[i : i + TREE_ROWS]) for i in cuts], *([c[i : i + TREE_ROWS] for i in cuts] for c in columns)


def taking_part(frame: DataFrame, scale: int, id_column: str, vector: str, label: Column) -> DataFrame:
    """Written rows (row, id, label, vector) with whole-number components, of those that take part."""
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(GREATEST)), F.lit(-GREATEST)))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = frame.filter(finite).select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), whole.alias("vector")
    )
    return stored(rows.filter("label IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "negatives")


def group_count(n: int) -> int:
    size = min(max(16 * math.isqrt(n), LEAST_ROWS), MOST_ROWS)
    return max(1, -(-n // size))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows of `taking_part`."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    groups = group_count(n)
    anchors = rows.filter(is_anchor)
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    def nearest(asked: pa.Table, group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(group) and len(asked):
            trees, row_of, id_of, label_of = grown(group, width)
            points, own, labels = matrix(asked["vector"], width), asked["row"].to_numpy(), asked["label"].to_numpy()
            for anchor, row, label in zip(points, own.tolist(), labels.tolist()):
                allowed = [(labels == label) & (rows != row) for labels, rows in zip(label_of, row_of)]
                for t, j, score in best_of(trees, id_of, allowed, anchor, positives, NEVER, -NEVER):
                    out.append((row, int(row_of[t][j]), int(id_of[t][j]), score))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], names=["row", "other", "other_id", "score"])

    def within(asked: pa.Table, group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(group) and len(asked):
            trees, _, id_of, label_of = grown(group, width)
            points = matrix(asked["vector"], width)
            for anchor, row, label, scores in zip(points, *(asked[c].to_pylist() for c in ("row", "label", "scores"))):
                allowed = [labels != label for labels in label_of]
                for score in scores:
                    least, most = -(-low * score // 100), high * score // 100
                    if least <= most:
                        for t, j, other in best_of(trees, id_of, allowed, anchor, negatives, least, most):
                            out.append((row, score, int(id_of[t][j]), other))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], names=["row", "positive_score", "negative_id", "negative_score"])

    dealt = dealt.repartition(groups * blocks, "group", "block") if groups * blocks > 1 else dealt
    asked = anchors.withColumn("block", block).withColumn("group", sent)
    partial = asked.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(nearest, "row long, other long, other_id long, score long")
    ranked = partial.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "other_id", "other")))
    chosen = stored(ranked.filter(F.col("place") <= positives), "positives")
    windows = chosen.groupBy("row").agg(F.collect_set("score").alias("scores"))  # at most `positives` each
    asked = stored(anchors.join(windows, "row"), "windows").withColumn("block", block).withColumn("group", sent)
    partial = asked.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(
        within, "row long, positive_score long, negative_id long, negative_score long"
    )
    order = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = chosen.select("row", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return (
        named.join(hard, ["row", "positive_score"])
        .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select(known("anchor_id"), known("positive_id"), F.col("rank").cast("int"), known("negative_id"), "positive_score", "negative_score")
    )
