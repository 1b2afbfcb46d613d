"""Stored domain tables under one root, read with their fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema as S

TABLES = {
    "projects": S.PROJECTS,
    "drawings": S.DRAWINGS,
    "detected_objects": S.DETECTED_OBJECTS,
    "boq_rules": S.BOQ_RULES,
    "boq_items": S.BOQ_ITEMS,
    "cost_versions": S.COST_VERSIONS,
    "materials": S.MATERIALS,
    "vendors": S.VENDORS,
    "labour_rates": S.LABOUR_RATES,
    "cost_history": S.COST_HISTORY,
    "exports": S.EXPORTS,
}


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, or only some of its columns; the files are read for those alone."""
    table = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    return table.select(*columns) if columns else table


def append_rows(rows: DataFrame, root: str, name: str) -> None:
    """Append rows in the stored types; columns that are not given are null.

    Money and quantities are stored as decimals and computed as doubles.
    """
    spark = rows.sparkSession
    schema = spark.createDataFrame([], TABLES[name]).schema
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    stored = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    rows.select(*stored).write.mode("append").parquet(f"{root}/{name}")
