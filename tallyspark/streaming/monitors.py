"""Windows over request and event logs; each takes batch or streaming input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import new_path
from tallyspark.sources import snapshots

WATERMARK = "5 minutes"


def _watermarked(log: DataFrame, delay: str) -> DataFrame:
    return log.withWatermark("ts", delay) if log.isStreaming else log


def failure_rates(
    log: DataFrame, window: str = "5 minutes", warn: float = 0.10, critical: float = 0.30, delay: str = WATERMARK
) -> DataFrame:
    """Share of failed calls per window, with its alert level."""
    rates = (
        _watermarked(log, delay)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("calls"), F.count_if(F.col("failed")).alias("failures"))
    )
    rate = F.col("failures") / F.col("calls")
    return rates.select(
        F.col("w.start").alias("window_start"),
        "calls",
        "failures",
        rate.alias("failure_rate"),
        F.when(rate > critical, "critical").when(rate > warn, "warning").otherwise("ok").alias("level"),
    )


def latency_percentiles(log: DataFrame, window: str = "1 hour", resolution: float = 0.01) -> DataFrame:
    """Exact p95 and p99 per window and route at the given resolution.

    The aggregate keeps one counter per different value; the resolution bounds
    how many there can be.
    """
    value = F.floor(F.col("latency") / resolution + 0.5) * resolution
    return (
        log.groupBy(F.window("ts", window).alias("w"), "route")
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.col("failed")).alias("failures"),
            F.percentile(value, F.array(F.lit(0.95), F.lit(0.99))).alias("p"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "route",
            "calls",
            (F.col("failures") / F.col("calls")).alias("error_rate"),
            F.get("p", F.lit(0)).alias("p95"),
            F.get("p", F.lit(1)).alias("p99"),
        )
    )


def latency_sketch(log: DataFrame, window: str = "1 hour", delay: str = WATERMARK, accuracy: int = 10_000) -> DataFrame:
    """Approximate p95 and p99 for streams, in bounded state."""
    return (
        _watermarked(log, delay)
        .groupBy(F.window("ts", window).alias("w"), "route")
        .agg(
            F.count("*").alias("calls"),
            F.percentile_approx("latency", [0.95, 0.99], accuracy).alias("p"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "route",
            "calls",
            F.get("p", F.lit(0)).alias("p95"),
            F.get("p", F.lit(1)).alias("p99"),
        )
    )


def latency_alerts(percentiles: DataFrame, warn: float = 5.0, critical: float = 10.0, slo_p95: float = 2.0, slo_errors: float = 0.10) -> DataFrame:
    return percentiles.withColumns(
        {
            "level": F.when(F.col("p99") > critical, "critical").when(F.col("p99") > warn, "warning").otherwise("ok"),
            "slo_met": (F.col("p95") < slo_p95) & (F.col("error_rate") < slo_errors),
        }
    )


def over_limit(log: DataFrame, limit: int, window: str = "1 minute", slide: str | None = None, delay: str = WATERMARK) -> DataFrame:
    """Keys with more requests in a window than allowed; with `slide` the windows overlap."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        _watermarked(log, delay)
        .groupBy(frame.alias("w"), "key")
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") > limit)
        .select(F.col("w.start").alias("window_start"), "key", "requests")
    )


def first_uploads(uploads: DataFrame, delay: str = "60 minutes", spread_by: str = "path", parts: int = 64) -> DataFrame:
    """Uploads without repeats of a content within the watermark delay.

    Repeats are removed in two steps, first within parts of each content, so that
    a content with very many copies is not shuffled to one task.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(parts))
    return (
        uploads.withWatermark("ts", delay)
        .withColumn("_part", part)
        .dropDuplicatesWithinWatermark(["sha256", "_part"])
        .dropDuplicatesWithinWatermark(["sha256"])
        .drop("_part")
    )


def upload_batches(
    spark: SparkSession, schema: T.StructType, name: str, root: str | None = None, rows_per_bucket: int = snapshots.ROWS_PER_BUCKET, pieces: int = 8
) -> tuple[Callable[[DataFrame, int], None], str]:
    """A batch handler that keeps the first upload of each hash in a store, for as long as the store lasts.

    The stream itself keeps no state. A batch keeps one upload of each hash it brings (the earliest, then the least path), reads
    the buckets of these hashes, and appends those that are not there; a batch that is replayed appends
    nothing. A table with a bucket of more than `pieces` appended pieces is written anew, in as many buckets as it needs by then.
    """
    root = root or new_path(spark, f"uploads-{name}")
    if not snapshots.versions(spark, root):
        commit = snapshots.begin(spark, root)
        commit.create("uploads", spark.createDataFrame([], schema), "sha256", buckets=1)
        commit.finish()

    def handle(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in ("sha256", "ts", "path")]
        first = batch.groupBy("sha256").agg(F.min(F.struct("ts", "path", *others)).alias("u")).select("sha256", "u.*").select(*batch.columns)
        first.write.mode("overwrite").parquet(f"{root}/first/batch_id={batch_id}")
        first = spark.read.schema(batch.schema).parquet(f"{root}/first/batch_id={batch_id}")
        known = snapshots.read_scope(spark, root, "uploads", first).select(F.col("sha256").alias("known"))
        commit = snapshots.begin(spark, root)
        commit.append("uploads", first.join(known, F.col("sha256").eqNullSafe(F.col("known")), "left_anti"))
        commit.finish()
        if max(map(len, snapshots.manifest(spark, root)[1]["uploads"].folders.values()), default=0) > pieces:
            commit = snapshots.begin(spark, root)
            commit.rebucket("uploads", rows_per_bucket=rows_per_bucket)
            commit.finish()
            snapshots.vacuum(spark, root)

    return handle, root
