"""Matching by vector similarity."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES = 4_096  # of a block
SCORES = 4_000_000  # held at a time by a task


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def class_centres(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label, aggregated by dimension so that no group is collected."""
    cells = vectors.select(label, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("p"))
    return packed.select(
        F.col(label).cast("long").alias("query_id"), F.transform("p", lambda e: e["m"]).alias("query")
    )


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def nearest_exact(queries: DataFrame, catalogue: DataFrame, k: int, max_queries: int = MAX_QUERIES) -> DataFrame:
    """The k most similar catalogue vectors of every query, by exact cosine.

    A join of blocks: the queries are dealt to blocks of about `max_queries` and the catalogue to
    groups, both by hash, so that copies crowd nowhere. Each pair of a block and a group is one task's matrix products and
    leaves k rows a query; the best of these are ranked. Every query is sent to every group and the
    catalogue once a block; no vector passes the driver.
    """
    blocks = max(1, -(-queries.count() // max_queries))
    groups = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.select("query_id", unit(F.col("query")).alias("query"), hashed("query_id", blocks).alias("block"))
    stored = catalogue.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), hashed("vec_id", groups).alias("part"))
    left = asked.withColumn("part", every(groups)).groupBy("block", "part")
    right = stored.withColumn("block", every(blocks)).groupBy("block", "part")
    return _ranked(left.cogroup(right).applyInArrow(partial(_best_of_block, k), "query_id long, vec_id long, similarity double"), k)


def _best_of_block(k: int, asked: pa.Table, stored: pa.Table) -> pa.Table:
    ids, keys = asked["query_id"].to_numpy(), stored["vec_id"].to_numpy()
    if not len(ids) or not len(keys):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "vec_id", "similarity"])
    matrix = np.array(asked["query"].to_pylist(), dtype=np.float64)
    best = np.empty((len(ids), 0))
    names = np.empty((len(ids), 0), dtype=np.int64)
    step = max(k, SCORES // len(ids))
    for i in range(0, len(keys), step):
        vectors = np.array(stored["embedding"].slice(i, step).to_pylist(), dtype=np.float64)
        lengths = np.linalg.norm(vectors, axis=1)[:, None]
        vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
        found = np.floor(matrix @ vectors.T * 1e6 + 0.5) / 1e6
        best = np.hstack([best, found])
        names = np.hstack([names, np.broadcast_to(keys[i : i + step], found.shape)])
        order = np.lexsort((names, -best), axis=1)[:, :k]
        best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
    return pa.table([np.repeat(ids, best.shape[1]), names.ravel(), best.ravel()], names=["query_id", "vec_id", "similarity"])


def nearest_approximate(
    queries: DataFrame, catalogue: DataFrame, k: int, bucket_length: float = 0.8, tables: int = 8, seed: int = 7
) -> DataFrame:
    """The k most similar vectors among those that share a random-projection bucket.

    Equal vectors are compared once. Of a group of copies only the first k can
    be among the k results, so no more of them are kept.
    """
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = (
        catalogue.select("vec_id", "embedding")
        .withColumn("copy", F.row_number().over(copies))
        .where(F.col("copy") <= k)
    )
    different = kept.where(F.col("copy") == 1).select(F.col("vec_id").alias("group_id"), "embedding")
    prepared = different.select("group_id", unit(F.col("embedding")).alias("v"))
    asked = queries.select("query_id", unit(F.col("query")).alias("q"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    features = prepared.withColumn("features", array_to_vector("v"))
    model = lsh.fit(features)

    def buckets(df: DataFrame, key: str) -> DataFrame:
        hashed = model.transform(df).select(key, F.posexplode("hashes").alias("table", "h"))
        return hashed.select(key, "table", F.get(vector_to_array("h"), F.lit(0)).cast("long").alias("bucket"))

    left = buckets(asked.withColumn("features", array_to_vector("q")), "query_id")
    right = buckets(features, "group_id")
    pairs = left.join(right, ["table", "bucket"]).select("query_id", "group_id").distinct()
    similarity = F.floor(dot(F.col("q"), F.col("v")) * 1e6 + 0.5) / 1e6
    scored = pairs.join(asked, "query_id").join(prepared, "group_id").select(
        "query_id", "group_id", similarity.alias("similarity")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "group_id")
    groups = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    members = kept.join(different, "embedding").select("vec_id", "group_id")
    return _ranked(groups.join(members, "group_id").select("query_id", "vec_id", "similarity"), k)
