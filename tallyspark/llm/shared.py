"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import new_path

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored frame of few columns, marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(frame) if frame.count() <= most else frame


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """From now on the session hands Python at most so many rows and bytes at once; a longer row is alone.

    A batch is held several times over, in the JVM and in Python, and processes seldom give such memory back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unused(columns: Iterable[str], name: str) -> str:
    """The name, made longer until no column has it; Spark's names ignore case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most `most` rows."""
    for batch in batches:
        for i in range(0, len(batch), most):
            yield batch.iloc[i : i + most]
