"""Near-duplicate embeddings: an exact metric range join over pivots.

Vectors are compared within a label and a number of dimensions, by the cosine in
double precision. On unit vectors a cosine of at least c is a distance of at most
r = sqrt(2 - 2 c). Pivots, vectors of the label itself, part it into cells: a
vector's home is the cell of its nearest pivot p. Whatever lies within r of a
vector x has its home in a cell q with d(x, q) - d(x, p) <= 2 r, by the triangle
inequality twice; x is replicated to these cells. So each cell has all partners
of the vectors at home in it, and cells are joined independently.

A cell with more than `BLOCK` vectors at home is split: each part holds some of
the homes and streams through all of the cell's vectors, sorted behind them, a
batch at a time. So a task's memory is bounded by a block and a batch, also when
one label or one cell holds most vectors. A part emits no pairs: it sums up the
partners of its homes and gives a spanning forest of the links of each tile.
In high dimensions with no structure, where all distances are alike, most cells
are within the bound and the join compares most vectors of a label in tiles.

Identical vectors are one from the start, with a count. Vectors that are null,
empty, zero or hold a null or a non-finite number link with nothing, nor do
vectors without a label. Ids may repeat or be null; a component is named by its
least id. At most `PIVOTS` vectors per label of more than `BLOCK` different
vectors are collected as pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.components import components, spanning_forest
from tallyspark.llm.shared import stored

BLOCK = 1024
PIVOTS = 64
SLACK = 1e-9  # for rounding, in distances of unit vectors
COUNTED, LINKED = 0, 1


def usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of equal length as rows of length 1."""
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _pivots(different: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit pivots by label and dimensions, of those with more than a block of vectors."""
    sizes = different.groupBy("label", "dims").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    order = Window.partitionBy("label", "dims").orderBy(F.xxhash64("rid"), "rid")
    first = different.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
    rows = (
        first.join(sizes, ["label", "dims"])
        .filter(F.col("place") <= F.ceil(F.col("n") / BLOCK))
        .select("label", "dims", "place", "embedding")
        .orderBy("label", "dims", "place")
        .collect()
    )
    found: dict[tuple, list] = {}
    for row in rows:
        found.setdefault((row["label"], row["dims"]), []).append(row["embedding"])
    return {key: unit_rows(vectors) for key, vectors in found.items()}


def _in_cells(different: DataFrame, radius: float) -> DataFrame:
    """Each vector with its home and the cells it is replicated to (its home first)."""
    sent = different.sparkSession.sparkContext.broadcast(_pivots(different))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = sent.value
        for rows in batches:
            for (label, dims), part in rows.groupby(["label", "dims"]):
                units = unit_rows(list(part["embedding"]))
                if (label, dims) in pivots:
                    apart = np.sqrt(np.maximum(0, 2 - 2 * units @ pivots[label, dims].T))
                    home = apart.argmin(axis=1)
                    near = apart - apart.min(axis=1, keepdims=True) <= 2 * radius + SLACK
                    cells = [np.concatenate([[h], np.flatnonzero(n & (np.arange(n.size) != h))]) for h, n in zip(home, near, strict=True)]
                else:
                    cells = [np.zeros(1, np.int64)] * len(part)
                yield pd.DataFrame(
                    {
                        "label": part["label"],
                        "dims": part["dims"],
                        "rid": part["rid"],
                        "weight": part["weight"],
                        "unit": list(units),
                        "cells": [c.astype(np.int32) for c in cells],
                    }
                )

    kind = different.schema["label"].dataType.simpleString()
    return different.mapInPandas(
        place, f"label {kind}, dims int, rid long, weight long, unit array<double>, cells array<int>"
    )


def _join(cosine: float):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, units, sums = None, [], [], None

        def closed() -> Iterator[pd.DataFrame]:
            if key is not None and sums is not None:
                yield pd.DataFrame({"kind": COUNTED, "a": ids, "b": np.int64(-1), "n": sums})

        for batch in batches:
            keys = batch["part"].to_numpy()
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for begin, end in zip(edges, np.append(edges[1:], len(batch)), strict=True):
                if keys[begin] != key:
                    yield from closed()
                    key, ids, units, sums = keys[begin], np.zeros(0, np.int64), None, None
                rows = batch.iloc[begin:end]
                side = rows["side"].to_numpy()
                own = rows[side == 0]
                if len(own):
                    more = np.array(own["unit"].tolist())
                    ids = np.concatenate([ids, own["rid"].to_numpy()])
                    units = more if units is None else np.concatenate([units, more])
                    sums = np.zeros(ids.size, np.int64)
                others = rows[side == 1]
                for i in range(0, len(others), BLOCK):
                    tile = others.iloc[i : i + BLOCK]
                    other_ids = tile["rid"].to_numpy()
                    linked = units @ np.array(tile["unit"].tolist()).T >= cosine
                    linked &= ids[:, None] != other_ids[None, :]
                    sums += linked @ tile["weight"].to_numpy()
                    a, b = spanning_forest(linked, ids, other_ids)
                    keep = a != b
                    if keep.any():
                        yield pd.DataFrame({"kind": LINKED, "a": a[keep], "b": b[keep], "n": np.int64(0)})
        yield from closed()

    return join


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.98,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (it names its component)."""
    rows = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(vector_column).alias("embedding"), F.col(label_column).alias("label")
    ).withColumn("usable", usable(F.col("embedding")) & F.col("label").isNotNull())
    sound = rows.filter("usable").select("vec_id", "embedding", "label")
    different = stored(
        sound.groupBy("label", "embedding")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
        .withColumn("dims", F.size("embedding"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "metric-vectors",
    )
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    placed = stored(_in_cells(different, radius), "metric-cells")

    home = F.element_at("cells", 1)
    parts = (
        placed.groupBy("label", "dims", home.alias("cell"))
        .agg(F.count("*").alias("homes"))
        .withColumn("parts", F.ceil(F.col("homes") / BLOCK).cast("int"))
    )
    here = placed.select("label", "dims", home.alias("cell"), "rid", "weight", "unit", F.lit(0).alias("side"))
    there = placed.select("label", "dims", F.explode("cells").alias("cell"), "rid", "weight", "unit", F.lit(1).alias("side"))
    members = here.unionByName(there).join(parts, ["label", "dims", "cell"])
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    number = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    spread = members.select(
        "label", "dims", "cell", "rid", "weight", "unit", "side",
        F.explode(F.when(F.col("side") == 0, F.array(number)).otherwise(every)).alias("number"),
    ).select(
        F.concat_ws("/", "label", "dims", "cell", "number").alias("part"), "side", "rid", "weight", "unit"
    )
    found = stored(
        spread.repartition("part")
        .sortWithinPartitions("part", "side")
        .mapInPandas(_join(cosine), "kind int, a long, b long, n long"),
        "metric-found",
    )
    counts = found.filter(F.col("kind") == COUNTED).select(F.col("a").alias("rid"), "n")
    joined = components(found.filter(F.col("kind") == LINKED).select("a", "b"))
    named = (
        different.select("rid", "label", "embedding", "weight", "least_id")
        .join(joined, F.col("rid") == F.col("node"), "left")
        .withColumn("part", F.coalesce("component", "rid"))
    )
    names = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    facts = (
        named.join(names, "part")
        .join(counts, "rid", "left")
        .select("label", "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    linked = sound.join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
