"""Keeping tables: keyed lookups, replacement, updates, deletes, history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.numbers import leading_number, money
from tallyspark.operators.boq import scoped


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """State of each key in a table that should hold it exactly once.

    The table is counted per key first, so a key held by very many rows costs
    one row in the join.
    """
    counts = table.groupBy(key).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return keys.select(key).join(counts, key, "left").select(
        key,
        n.alias("found"),
        F.when(n == 0, "missing").when(n == 1, "ok").otherwise("duplicate").alias("state"),
    )


def in_scope(table: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(scope.select(*keys).distinct(), list(keys), "left_semi")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replaced(old: DataFrame, new: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the rows in scope were exchanged for the new ones.

    The scope is given apart from the new rows: a project whose new result is
    empty loses its old rows.
    """
    kept = old.join(scope.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """Store a table in folders by project bucket.

    The rebalance hint merges small pieces of a bucket into one file and splits
    a bucket that one large project fills.
    """
    df.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; the marker rows of rewritten buckets are left out."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    return rows.where(F.col("project_id").isNotNull())


def replace_bucketed(path: str, new: DataFrame, scope: DataFrame, keys: Sequence[str], buckets: int) -> None:
    """Exchange the rows in scope, rewriting only the buckets that hold its projects.

    Each rewritten bucket gets one marker row without project. Dynamic overwrite
    replaces the buckets it receives rows for, so without a marker a bucket that
    became empty would keep its old rows.
    """
    spark = new.sparkSession
    touched = scope.select(_bucket(buckets).alias("bucket")).distinct()
    numbers = [r[0] for r in touched.collect()]  # at most `buckets` small numbers
    if not numbers:
        return
    old = read_bucketed(spark, path, new.schema).where(F.col("bucket").isin(numbers)).drop("bucket")
    result = replaced(old, new, scope, keys).withColumn("bucket", _bucket(buckets))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema]
    markers = touched.select(*empty, "bucket")
    (
        result.unionByName(markers)
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def updated(base: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite the listed columns where a patch gives a value; ignore all others.

    One patch row per key.
    """
    given = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(given, key, "left")
    return joined.select(
        *[
            (F.coalesce(F.col(f"_new_{c}").cast(base.schema[c].dataType), F.col(c)).alias(c) if c in columns else F.col(c))
            for c in base.columns
        ]
    )


def valid_edits(edits: DataFrame) -> DataFrame:
    """Edits as typed by users: (id, field, raw). Texts that start with no number,
    and negative numbers, are ignored; of several edits of a field the last one counts."""
    value = leading_number(F.col("raw"))
    return (
        edits.where(F.col("field").isin("quantity", "rate"))
        .withColumn("value", value)
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0))
        .groupBy("id", "field")
        .agg(F.max_by("value", F.struct("ts", "edit_id")).alias("value"))
    )


def edit_patches(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Patches (quantity, rate, recomputed total) from valid edits."""
    wide = (
        valid_edits(edits)
        .groupBy("id")
        .agg(
            F.max(F.when(F.col("field") == "quantity", F.col("value"))).alias("_q"),
            F.max(F.when(F.col("field") == "rate", F.col("value"))).alias("_r"),
        )
    )
    joined = lines.select("id", "quantity", "rate").join(wide, "id")
    quantity = F.coalesce("_q", F.col("quantity").cast("double"))
    rate = F.coalesce("_r", F.col("rate").cast("double"))
    return joined.select(
        "id", quantity.alias("quantity"), rate.alias("rate"), money(quantity * rate).alias("total")
    )


def with_status(drawings: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the status of drawings; the detection time changes only when given."""
    return updated(drawings, updates, "id", ["status", "detected_at"])


def delete_projects(
    gone: DataFrame, projects: DataFrame, children: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Delete projects with all rows that hang on them, in every child table."""
    keys = gone.select("project_id").distinct()
    left = {
        name: table.join(keys, "project_id", "left_anti") for name, table in children.items()
    }
    left["projects"] = projects.join(keys, projects["id"] == keys["project_id"], "left_anti")
    return left


def unlink_missing(children: DataFrame, parents: DataFrame, reference: str, parent_key: str = "id") -> DataFrame:
    """Null a reference whose parent row is gone."""
    present = parents.select(F.col(parent_key).alias(reference)).distinct().withColumn("_present", F.lit(True))
    return children.join(present, reference, "left").select(
        *[
            (F.when(F.col("_present"), F.col(c)).alias(c) if c == reference else F.col(c))
            for c in children.columns
        ]
    )


def touch_projects(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Raise `updated_at` to the newest change of any child row."""
    newest = changes.groupBy("project_id").agg(F.max("changed_at").alias("_newest"))
    joined = projects.join(newest, projects["id"] == newest["project_id"], "left").drop("project_id")
    return joined.withColumn("updated_at", F.greatest("updated_at", "_newest")).drop("_newest")


def deliverable_log(exports: DataFrame, project_id: int | None = None) -> DataFrame:
    """Deliverables, newest first, of all projects or of one."""
    return scoped(exports, project_id=project_id).orderBy(F.desc("created_at"), F.desc("id"))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def by_name(df: DataFrame, column: str, *ties: str | Column) -> DataFrame:
    """Ascending, missing names last."""
    return df.orderBy(F.asc_nulls_last(column), *(ties or ("id",)))
