"""Drawing files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def manifest(files: DataFrame) -> DataFrame:
    """Name, type, size, first bytes and content hash of (path, length, content)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path",
        name.alias("name"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"),
        "length",
        F.hex(F.substring("content", 1, 4)).alias("head"),
        F.sha2("content", 256).alias("sha256"),
    )


def first_of_each_content(files: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """One file per content, the one with the lowest key, and the number of copies.

    Only the hash and the key are shuffled, already reduced by map-side
    aggregation, so a content with very many copies costs no task more.
    """
    return files.groupBy(digest).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def not_yet_processed(files: DataFrame, processed: DataFrame, digest: str = "sha256") -> DataFrame:
    return files.join(processed.select(digest).distinct(), digest, "left_anti")
