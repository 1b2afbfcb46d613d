"""Approximate nearest neighbours by inner product over a graph that NN-descent builds.

Different vectors are the nodes; rows with the same vector are its members and come in at the
end, so copies do not crowd the graph. A further coordinate, the root of the greatest squared
norm less the own one, makes the nearest in Euclidean distance of all nodes those of greatest
product; a query has 0 there.

NN-descent: nodes start with the nearest of two random buckets. In every round each node
draws some new and some old neighbours, forwards and backwards, and proposes all pairs with a new one among
them to each other (neighbours of neighbours); a pair is kept where it beats the
neighbours so far. The lists, the vectors they need and the proposals meet by joins on parts of the
nodes; a part gets a vector once however many of its lists hold it. Rounds end when less than
`CHANGED` of all neighbours are new, or after a number that grows with the logarithm of the nodes.

A query searches greedily: it holds the best nodes seen, opens those not opened yet, up to
`OPENED` a round, and scores their neighbours both ways that it does not hold. It starts at its own node
and at `LANDMARKS` random ones. Opened nodes join the graph; the new ones go to their parts with the
query's vector, once a part, and come back with exact scores in double precision. Every
intermediate table is written to the shared folder. Bounded: neighbours, draws, landmarks, nodes held by a query. These
are the parameters of an approximate search; recall is measured against brute force in the tests.

Rows with null, zero or not finite vectors take no part. Vectors of several lengths count as
filled up with zeros. Repeated ids are rows of their own, null ids are neither queries nor smaller than others.
Ties go to the smaller id; fewer rows than asked for give fewer, an empty table an empty one. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import stored

NEIGHBOURS = 40
DRAWN = 20
CHANGED = 0.01
OPENED = 64
ROUNDS = 7
HELD = 512
LANDMARKS = 64
RETURNED = 256  # scored nodes of a part and query
PART_ROWS = 8192
LEAST_PARTS, LEAST_ROWS = 16, 256  # so many parts, where they have as many rows
NO_ID = (1 << 63) - 1
LISTS = "node long, others array<long>, nearness array<float>, new array<boolean>"


def part_count(n: int) -> int:
    return max(-(-n // PART_ROWS), min(LEAST_PARTS, -(-n // LEAST_ROWS)))


def part_of(node: str, parts: int) -> Column:
    return F.pmod(F.col(node), F.lit(parts)).cast("int")


def dense(column: pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=kind)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def ragged(owner: np.ndarray, count: int, *columns: np.ndarray) -> list[pa.ListArray]:
    """Lists per owner 0 to count - 1, from columns sorted by it."""
    offsets = pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def best_lists(node: np.ndarray, other: np.ndarray, nearness: np.ndarray, new: np.ndarray, k: int) -> pa.Table:
    """The k nearest others of each node; of an other named twice the old entry stays."""
    order = np.lexsort((new, other, node))
    node, other, nearness, new = node[order], other[order], nearness[order], new[order]
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, nearness, new = node[first], other[first], nearness[first], new[first]
    order = np.lexsort((other, -nearness, node))
    node, other, nearness, new = node[order], other[order], nearness[order], new[order]
    names, start, owner = np.unique(node, return_index=True, return_inverse=True)
    kept = np.arange(len(node)) - start[owner] < k if len(node) else np.zeros(0, dtype=bool)
    lists = ragged(owner[kept], len(names), other[kept], nearness[kept].astype(np.float32), new[kept])
    return pa.table([pa.array(names, pa.int64()), *lists], names=["node", "others", "nearness", "new"])


def flat(table: pa.Table, *names: str) -> list[np.ndarray]:
    """The node of each entry of a table's lists, and the entries."""
    lists = [table[n].combine_chunks() for n in names]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return [np.repeat(table["node"].to_numpy(), sizes), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)]


def lifted(points: np.ndarray, greatest: float) -> np.ndarray:
    return np.column_stack([points, np.sqrt(np.maximum(greatest - (points**2).sum(axis=1), 0))])


def nodes_of(frame: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: nodes (node, vector), and rows (row, id, node)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = frame.filter(finite & F.exists(vector, lambda x: x != 0)).select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector")
    )
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")})
    rows = stored(rows, "vectors")
    nodes = stored(rows.groupBy("h", "g").agg(F.min(F.struct("row", "vector")).alias("one")).select("h", "g", "one.row", "one.vector"), "nodes")
    nodes = nodes.withColumnRenamed("row", "node")
    members = stored(rows.select("row", "id", "h", "g").join(nodes.select("h", "g", "node"), ["h", "g"]).select("row", "id", "node"), "members")
    return nodes.select("node", "vector"), members


def build_graph(nodes: DataFrame, n: int, width: int, greatest: float, k: int = NEIGHBOURS, drawn: int = DRAWN) -> DataFrame:
    """A written table (node, others, nearness, new) of each node's nearest others, by NN-descent."""
    parts = part_count(n)

    def bucket(rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()
        points = lifted(dense(rows["vector"], width), greatest)
        found = []
        for i in range(0, len(node), 1024):
            near = points[i : i + 1024] @ points.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            m = min(k, len(node) - 1)
            best = np.argpartition(-near, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(near), 0), int)
            found.append((np.repeat(node[i : i + 1024], best.shape[1]), node[best].ravel(), np.take_along_axis(near, best, 1).ravel()))
        a, b, near = map(np.concatenate, zip(*found))
        return best_lists(a, b, near, np.ones(len(a), dtype=bool), k)

    def merged(lists: pa.Table, others: pa.Table) -> pa.Table:
        node, other, near, new = flat(lists, "others", "nearness", "new")
        more = flat(others, "others", "nearness", "new")
        return best_lists(*(np.concatenate(pair) for pair in zip((node, other, near, new), more)), k)

    def in_parts(frame: DataFrame) -> DataFrame:
        return frame.withColumn("part", part_of("node", parts)).groupBy("part")

    first, second = (
        nodes.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(parts)).cast("int")).repartition(parts, "part").groupBy("part").applyInArrow(bucket, LISTS)
        for seed in (1, 2)
    )
    lists = stored(in_parts(first).cogroup(in_parts(second)).applyInArrow(merged, LISTS), "graph")

    for turn in range(max(3, math.ceil(math.log2(max(n, 2)) / 3))):
        draw = lambda new, turn=turn: F.slice(
            F.array_sort(
                F.transform(
                    F.filter(F.arrays_zip("others", "new"), lambda x: x["new"] == new),
                    lambda x: F.struct(F.xxhash64(F.lit(turn), "node", x["others"]).alias("h"), x["others"].alias("other")),
                )
            ),
            1,
            drawn,
        )["other"]
        drawn_lists = stored(
            lists.select("node", draw(True).alias("fresh"), draw(False).alias("old"), F.try_element_at("nearness", F.lit(-1)).alias("least"), F.size("others").alias("size")), "drawn"
        )
        ways = [drawn_lists.select(F.explode(c).alias("node"), F.col("node").alias("other"), F.lit(c == "fresh").alias("new")) for c in ("fresh", "old")]

        def both_ways(own: pa.Table, back: pa.Table) -> pa.Table:
            sides = []
            for name in ("fresh", "old"):
                node, other = flat(own, name)
                is_new = back["new"].to_numpy(zero_copy_only=False) == (name == "fresh")
                to, source = back["node"].to_numpy()[is_new], back["other"].to_numpy()[is_new]
                mixed = np.random.default_rng(len(to)).permutation(len(to))
                mixed = mixed[np.argsort(to[mixed], kind="stable")]
                to, source = to[mixed], source[mixed]
                names, start, owner = np.unique(to, return_index=True, return_inverse=True)
                kept = np.arange(len(to)) - start[owner] < drawn if len(to) else np.zeros(0, dtype=bool)
                sides.append((np.concatenate([node, to[kept]]), np.concatenate([other, source[kept]])))
            names = np.unique(np.concatenate([s[0] for s in sides]))
            lists = []
            for node, other in sides:
                order = np.argsort(node, kind="stable")
                lists += ragged(np.searchsorted(names, node[order]), len(names), other[order])
            return pa.table([pa.array(names, pa.int64()), *lists], names=["node", "fresh", "old"])

        joint = stored(in_parts(drawn_lists).cogroup(in_parts(ways[0].union(ways[1]))).applyInArrow(both_ways, "node long, fresh array<long>, old array<long>"), "joint")
        joint = joint.withColumn("part", part_of("node", parts))
        least = drawn_lists.select(F.col("node").alias("other"), F.when(F.col("size") >= min(k, n - 1), F.col("least")).alias("least"))
        wanted = joint.select(F.col("part").alias("home"), F.explode(F.array_union("fresh", "old")).alias("other")).distinct()
        known = nodes.select(F.col("node").alias("other"), F.transform("vector", lambda x: x.cast("float")).alias("vector")).join(least, "other", "left")
        needed = wanted.join(known, "other").select("home", F.col("other").alias("name"), "vector", F.coalesce("least", F.lit(float("-inf")).cast("float")).alias("least"))

        def proposals(lists: pa.Table, needed: pa.Table) -> pa.Table:
            name = needed["name"].to_numpy()
            order = np.argsort(name)
            name, bar = name[order], needed["least"].to_numpy()[order]
            points = lifted(dense(needed["vector"], width, np.float32)[order].astype(np.float64), greatest).astype(np.float32)
            columns = []
            for c in ("fresh", "old"):
                x = lists[c].combine_chunks()
                columns.append((np.searchsorted(name, x.flatten().to_numpy()), x.offsets.to_numpy() - x.offsets[0].as_py()))
            (fresh, fresh_at), (old, old_at) = columns
            out = []
            for i in range(len(lists)):
                a = np.unique(fresh[fresh_at[i] : fresh_at[i + 1]])
                if not len(a):
                    continue
                b = np.setdiff1d(old[old_at[i] : old_at[i + 1]], a)
                all_of = np.concatenate([a, b])
                near = points[a] @ points[all_of].T
                x, y = np.nonzero((near > bar[a][:, None]) | (near > bar[all_of][None, :]))
                x, y = x[a[x] != all_of[y]], y[a[x] != all_of[y]]
                out.append((a[x], all_of[y], near[x, y]))
            a, b, near = map(np.concatenate, zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
            a, b, near = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([near, near])
            better = near > bar[a]
            return best_lists(name[a[better]], name[b[better]], near[better], np.ones(int(better.sum()), dtype=bool), k)

        found = joint.groupBy("part").cogroup(needed.groupBy("home")).applyInArrow(proposals, LISTS)
        still_new = F.zip_with("others", "new", lambda x, new: new & ~F.array_contains("fresh", x)).alias("new")
        kept = lists.join(drawn_lists.select("node", "fresh"), "node").select("node", "others", "nearness", still_new)
        lists = stored(in_parts(kept).cogroup(in_parts(found)).applyInArrow(merged, LISTS), "graph")
        changed, all_of = lists.select(F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("others"))).first()
        if (changed or 0) <= CHANGED * (all_of or 0):
            break
    return lists


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, n: int, width: int, k: int) -> DataFrame:
    """Greedy search from each of the nodes `queries`: (query, node, score) of the best it met, own node included, at least k with ties."""
    parts = part_count(n)
    backwards = graph.select(F.posexplode("others").alias("place", "node"), F.col("node").alias("other"))
    order = Window.partitionBy("node").orderBy("place", "other")
    back = backwards.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEIGHBOURS).groupBy("node").agg(F.collect_list("other").alias("back"))
    graph = stored(graph.join(back, "node", "left").select("node", F.array_union("others", F.coalesce("back", F.array().cast("array<long>"))).alias("others")), "both-ways")
    points = nodes.withColumn("part", part_of("node", parts))
    landmarks = [r[0] for r in nodes.select("node").orderBy(F.xxhash64("node")).limit(LANDMARKS).collect()]
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("held", "long"), ("scores", "double"), ("opened", "boolean"))]
    begin = F.array_union(F.array("node"), F.array(*map(F.lit, landmarks)).cast("array<long>"))
    state = queries.join(nodes, "node").select("node", "vector", *empty, begin.alias("asked"))
    state_schema = "node long, vector array<double>, held array<long>, scores array<double>, opened array<boolean>, asked array<long>"
    scored_schema = "node long, found array<long>, scores array<double>"

    def requests(state: pa.Table, near: pa.Table) -> pa.Table:
        """The nodes to score: neighbours of opened nodes that the query does not hold, by part."""
        asked: dict[int, list] = {}
        for q, others in zip(near["asker"].to_pylist(), near["offered"].combine_chunks()):
            asked.setdefault(q, []).append(others.values.to_numpy())
        rows = []
        held = state["held"].combine_chunks()
        for i, q in enumerate(state["node"].to_pylist()):
            if q in asked:
                new = np.setdiff1d(np.concatenate(asked[q]), held[i].values.to_numpy())
                part = new % parts
                by_part = np.argsort(part, kind="stable")
                names, start = np.unique(part[by_part], return_index=True)
                rows += [(int(p), q, i, ids) for p, ids in zip(names, np.split(new[by_part], start[1:]))]
        part, q, i, ids = zip(*rows) if rows else ((),) * 4
        lists = ragged(np.repeat(np.arange(len(ids)), [len(x) for x in ids]), len(ids), np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64))
        vectors = state["vector"].combine_chunks().take(pa.array(i, pa.int64()))
        return pa.table([pa.array(part, pa.int32()), pa.array(q, pa.int64()), vectors, *lists], names=["part", "node", "vector", "asked"])

    def scored(asked: pa.Table, points: pa.Table) -> pa.Table:
        name = points["node"].to_numpy()
        order = np.argsort(name)
        vectors, name = dense(points["vector"], width)[order], name[order]
        found, scores = [], []
        for vector, ids in zip(dense(asked["vector"], width), asked["asked"].combine_chunks()):
            ids = ids.values.to_numpy()
            score = vectors[np.searchsorted(name, ids)] @ vector
            best = np.argpartition(-score, RETURNED)[:RETURNED] if len(score) > RETURNED else np.arange(len(score))
            found.append(ids[best])
            scores.append(score[best])
        owner = np.repeat(np.arange(len(found)), np.array([len(x) for x in found], dtype=np.int64))
        lists = ragged(owner, len(found), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*scores, np.zeros(0)]))
        return pa.table([asked["node"], *lists], names=["node", "found", "scores"])

    def updated(state: pa.Table, scored: pa.Table) -> pa.Table:
        """Hold the best, and choose which to open next."""
        more: dict[int, list] = {}
        for q, ids, values in zip(scored["node"].to_pylist(), scored["found"].combine_chunks(), scored["scores"].combine_chunks()):
            more.setdefault(q, []).append((ids.values.to_numpy(), values.values.to_numpy()))
        out = []
        held, scores, opened = (state[c].combine_chunks() for c in ("held", "scores", "opened"))
        for i, q in enumerate(state["node"].to_pylist()):
            new = more.get(q, [])
            ids = np.concatenate([held[i].values.to_numpy(), *(x[0] for x in new)]).astype(np.int64)
            values = np.concatenate([scores[i].values.to_numpy(), *(x[1] for x in new)]).astype(np.float64)
            done = np.concatenate([opened[i].values.to_numpy(zero_copy_only=False), np.zeros(len(ids) - len(held[i]), bool)]).astype(bool)
            best = np.lexsort((ids, -values))[:HELD]
            ids, values, done = ids[best], values[best], done[best]
            nearest = np.flatnonzero(~done)
            own = nearest[ids[nearest] == q]  # the own node is opened first, whatever its score
            nearest = np.concatenate([own, nearest[ids[nearest] != q]])[:OPENED]
            done[nearest] = True
            out.append((ids, values, done, ids[nearest]))
        columns = []
        for column, kind in zip(zip(*out) if out else ((),) * 4, (np.int64, np.float64, bool, np.int64)):
            owner = np.repeat(np.arange(len(column)), np.array([len(x) for x in column], dtype=np.int64))
            columns += ragged(owner, len(column), np.concatenate([*column, np.zeros(0, kind)]).astype(kind))
        return pa.table([state["node"], state["vector"], *columns], names=["node", "vector", "held", "scores", "opened", "asked"])

    def by_query(frame: DataFrame) -> DataFrame:
        return frame.withColumn("part", part_of("node", parts)).groupBy("part")

    state = stored(state, "state")
    for turn in range(ROUNDS):
        if turn:
            near = state.select("node", F.explode("asked").alias("other")).join(graph.withColumnRenamed("node", "other"), "other")
        else:
            near = state.withColumn("others", F.col("asked"))
        near = near.select(F.col("node").alias("asker"), F.col("others").alias("offered"), part_of("node", parts).alias("home"))
        asked = by_query(state).cogroup(near.groupBy("home")).applyInArrow(requests, "part int, node long, vector array<double>, asked array<long>")
        results = asked.groupBy("part").cogroup(points.groupBy("part")).applyInArrow(scored, scored_schema)
        state = stored(by_query(state).cogroup(by_query(results)).applyInArrow(updated, state_schema), "state")
        if not state.filter(F.size("asked") > 0).limit(1).count():
            break
    best = F.element_at("scores", F.least(F.size("scores"), F.lit(k)))
    pairs = F.explode(F.filter(F.arrays_zip("held", "scores"), lambda x: x["scores"] >= best))
    return state.select(F.col("node").alias("query"), pairs.alias("p")).select("query", F.col("p.held").alias("node"), F.col("p.scores").alias("score"))


def nearest(frame: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, itself left out. `is_query` reads the column `id`."""
    nodes, members = nodes_of(frame, id_column, vector)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, width, greatest = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    asking = members.filter(is_query & (F.col("id") != NO_ID))
    if n == 0:
        return asking.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    graph = build_graph(nodes, n, width, greatest)
    found = search(nodes, graph, asking.select("node").distinct(), n, width, k + 1)
    first = Window.partitionBy("node").orderBy("id", "row")
    few = members.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).drop("place")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    best = found.join(few, "node").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    best = stored(best.select("query", "row", "id", "score"), "best")
    asking = asking.select(F.col("node").alias("query"), F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    pairs = asking.join(best, "query").filter(F.col("row") != F.col("query_row"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"), "score")
