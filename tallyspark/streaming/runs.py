"""Running a stream into a table under the shared folder.

Each micro-batch overwrites its own `batch_id` folder, so a batch that is
replayed after a failure leaves the same table. Nothing passes through the
driver's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark.session import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELIVERY_FILES = 32


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state outside the heap; custom state needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the Parquet files of a path."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deliver(rows: DataFrame, path: str, by: Sequence[str] = (), files: int = DELIVERY_FILES) -> None:
    """Add a delivery to the files a stream reads, in a fixed number of files.

    Rows are dealt by the columns `by`, whose values should differ, or in turn, which sorts them all first.
    """
    rows.repartition(files, *by).write.mode("append").parquet(path)


def delivered(rows: DataFrame, number: Column, heartbeat: DataFrame, name: str, files: int = DELIVERY_FILES) -> DataFrame:
    """A stream of stored rows that arrive in deliveries, in the order of their numbers, one in a micro-batch.

    The rows are worked out once and put aside by delivery. Each delivery comes in the same number of files, so that
    large ones are no more micro-batches than small ones; one of fewer rows than files shares its batch with the next.
    The heartbeat, a row far in the future, comes last and lets the watermark pass all others.
    """
    spark = rows.sparkSession
    path, aside = new_path(spark, f"delivered-{name}"), new_path(spark, f"aside-{name}")
    numbered = rows.withColumn("_delivery", number)
    numbered.write.partitionBy("_delivery").parquet(aside)
    aside = spark.read.schema(numbered.schema).parquet(aside).where(F.col("_delivery").isNotNull())
    for (which,) in aside.select("_delivery").distinct().orderBy("_delivery").collect():
        deliver(aside.where(F.col("_delivery") == which).drop("_delivery"), path, files=files)
    heartbeat.coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, rows.schema, files_per_batch=files)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    progress: str,
    mode: str = "update",
    **trigger: object,
) -> StreamingQuery:
    """Start a stream that hands its micro-batches to `on_batch`.

    `progress` is a lasting folder; a stream started again with it goes on where
    it stopped. Triggers are those of `DataStreamWriter.trigger`.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", progress)
    return (writer.trigger(**trigger) if trigger else writer).start()


def drain(
    stream: DataFrame, name: str, mode: str = "update", on_batch: Callable[[DataFrame, int], None] | None = None
) -> str:
    """Process all data that is there and return the path of the written batches."""
    spark = stream.sparkSession
    path = new_path(spark, f"stream-{name}")
    query = start(
        stream, on_batch or batch_writer(path), new_path(spark, f"progress-{name}"), mode, availableNow=True
    )
    query.awaitTermination()
    return path


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key, from batches in update mode."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(with_batch).parquet(path)
    values = [f.name for f in schema if f.name not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
        .select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])
    )


def drained(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run a stream in update mode and return the last row of each key."""
    path = drain(stream, name)
    return latest(stream.sparkSession, path, stream.schema, keys)


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode and return all rows."""
    path = drain(stream, name, mode="append")
    rows = stream.sparkSession.read.schema(stream.schema).parquet(path)
    return rows.select(*stream.columns)  # without the batch the rows came in
