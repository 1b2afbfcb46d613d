"""Micro-batches of a stored stream, and pieces of state, are as many for large tables as for small ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.streaming import deadlines, runs


def test_a_delivery_is_one_batch_however_many_tasks_write_it(spark):
    rows = spark.range(0, 4000, 1, 100).select("id", F.col("id").alias("ts"))
    stream = runs.delivered(rows, F.col("id") % 2, rows.limit(0), "t-tasks")
    seen = {}
    runs.drain(stream, "t-tasks", "append", lambda batch, i: seen.update({i: sorted({r["id"] % 2 for r in batch.collect()})}))
    assert list(seen.values()) == [[0], [1], []] or list(seen.values()) == [[0], [1]]


def test_keys_share_state(spark):
    """Of 3000 keys with open work no more pieces are kept than there are groups; a null key and negative ones are keys."""
    runs.use_rocksdb(spark)
    start = 1_700_006_400
    key = F.when(F.col("id") == 5, None).otherwise(F.col("id") - 1500)
    log = spark.range(3000).select(
        key.alias("key"), F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "STARTED").otherwise("DONE").alias("status"),
        F.timestamp_seconds(F.lit(start) + F.col("id") % 7).alias("ts"),
    )
    more = log.withColumn("event_id", F.col("event_id") + 10_000).withColumn("status", F.lit("DONE")).where("event_id % 2 = 0")
    more = more.withColumn("ts", F.timestamp_seconds(F.lit(start + 100)))
    end = spark.range(1).select(F.lit(9999).cast("long").alias("key"), F.lit(-1).cast("long").alias("event_id"), F.lit("x").alias("status"), F.timestamp_seconds(F.lit(start + 10**6)).alias("ts"))
    stream = runs.delivered(log.union(more), (F.col("event_id") >= 10_000).cast("int"), end, "t-groups")
    found = []
    path = runs.new_path(spark, "t-groups")
    query = runs.start(deadlines.stuck_work_stream(stream, "STARTED", delay="1 hour", groups=4), lambda b, i: found.extend(b.collect()), path, "append", availableNow=True)
    query.awaitTermination()
    assert sorted(r["event_id"] for r in found) == [i for i in range(0, 3000, 3) if i % 2]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(kept) <= 4 * 3


def test_a_batch_is_expanded_without_being_kept_or_shuffled(spark):
    """Only drawings with several uploads in the batch are looked up; a replay leaves the same lines."""
    from tallyspark.streaming import live

    rows = spark.range(3000).select(
        (F.col("id") % 7).alias("project_id"), F.when(F.col("id") != 2999, F.col("id") % 50).alias("drawing_id"), "id",
        F.when(F.col("id") % 50 < 3, F.col("id") % 3).otherwise(F.lit(0)).alias("upload_id"),
    )
    plans = []

    def expand(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return batch

    handle, path = live.expand_batches(spark, expand, "t-narrow")
    handle(rows, 0)
    handle(rows, 0)
    assert not [p for p in plans if "Exchange hashpartitioning" in p or "InMemoryTableScan" in p]
    kept = live.current_lines(spark, path, rows.drop("upload_id").schema)
    last = rows.groupBy("project_id", "drawing_id").agg(F.max("upload_id").alias("upload_id"))
    expected = rows.join(last, ["project_id", "drawing_id", "upload_id"]).select("id")
    assert sorted(kept.select("id").collect()) == sorted(expected.collect())
    assert 0 < kept.count() < 2999
