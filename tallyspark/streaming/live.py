"""Live bills: change events merged into lines, live totals, re-expansion.

The merging functions take batch or streaming input alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.numbers import cents, from_cents
from tallyspark.session import new_path
from tallyspark.sources import snapshots

FIELDS = ("total", "rate", "material_name")


def last_values(events: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Per line and field the last value that was sent; events without the field
    leave it alone."""
    moment = F.struct("ts", "event_id")
    return events.groupBy("boq_item_id").agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), moment)).alias(f) for f in fields]
    )


def live_lines(lines: DataFrame, changes: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Lines with the last sent values put over the stored ones."""
    sent = changes.select(F.col("boq_item_id").alias("id"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = lines.join(sent, "id", "left")
    return joined.select(
        *[(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)) for c in lines.columns]
    )


def live_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("project_id").agg(
        from_cents(F.sum(cents(F.coalesce("total", F.lit(0.0))))).alias("total"), F.count("*").alias("lines")
    )


def total_batches(
    lines: DataFrame, name: str, root: str | None = None, rows_per_bucket: int = snapshots.ROWS_PER_BUCKET, keep: int = 8
) -> tuple[Callable[[DataFrame, int], None], str]:
    """A batch handler for the stream of last values that keeps current lines and project totals in a store.

    Lines are bucketed by id and totals by project. A batch merges its values into the lines of the buckets it touches,
    adds what that changes to the totals, and commits both at once; a bucket is one compact piece after every
    batch, so reads do not grow with the batches. Values of a batch that is replayed are there already
    and change nothing. The totals a batch changed are left in `totals/batch_id=<n>` for followers. Versions older than the last `keep` are removed. A stream that goes on is given its `root`.
    """
    spark = lines.sparkSession
    root = root or new_path(spark, f"totals-{name}")
    if not snapshots.versions(spark, root):
        commit = snapshots.begin(spark, root)
        commit.create("lines", lines, "id", rows_per_bucket=rows_per_bucket)
        commit.create("totals", live_totals(lines), "project_id", rows_per_bucket=rows_per_bucket)
        commit.finish()

    def handle(batch: DataFrame, batch_id: int) -> None:
        values = f"{root}/values/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(values)
        batch = spark.read.schema(batch.schema).parquet(values)
        commit = snapshots.begin(spark, root)
        touched = batch.select(F.col("boq_item_id").alias("id"))
        old = snapshots.read_scope(spark, root, "lines", touched)
        new = live_lines(old, batch)
        change = cents(F.coalesce("total", F.lit(0.0)))
        both = old.select("project_id", (-change).alias("change")).unionByName(new.select("project_id", change.alias("change")))
        moved = both.groupBy("project_id").agg(F.sum("change").alias("change")).persist()
        commit.replace("lines", new, touched)
        stored = snapshots.read_scope(spark, root, "totals", moved).alias("stored")
        joined = stored.join(moved.alias("moved"), F.col("stored.project_id").eqNullSafe(F.col("moved.project_id")))
        totals = joined.select("stored.project_id", from_cents(cents(F.col("total")) + F.col("change")).alias("total"), "lines")
        totals.write.mode("overwrite").parquet(f"{root}/totals/batch_id={batch_id}")
        commit.replace("totals", spark.read.schema(totals.schema).parquet(f"{root}/totals/batch_id={batch_id}"), moved)
        commit.finish()
        moved.unpersist()
        if len(snapshots.versions(spark, root)) > 2 * keep:
            snapshots.vacuum(spark, root, keep)

    return handle, root


def current_totals(lines: DataFrame, root: str) -> DataFrame:
    """Totals of all projects as of the last batch."""
    return snapshots.read(lines.sparkSession, root, "totals")


def events_on_lines(events: DataFrame, lines: DataFrame) -> DataFrame:
    """Events beside the current line; an event for an unknown line keeps no line."""
    current = lines.select(F.col("id").alias("boq_item_id"), "project_id", F.col("total").alias("current_total"))
    return events.join(current, "boq_item_id", "left")


def newest_rows(batch: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of a batch without those an upload of the same batch replaces. `several` lists the drawings with more than one
    upload in it, and the last of these; it is short as a rule, and then the batch is not shuffled."""
    last = several.select(*[F.col(c).alias(f"_{c}") for c in several.columns])
    same = (F.col("project_id") == F.col("_project_id")) & (F.col("drawing_id") == F.col("_drawing_id"))
    return batch.join(last, same & (F.col("upload_id") < F.col("_upload_id")), "left_anti")


def expand_batches(
    spark: SparkSession, expand: Callable[[DataFrame], DataFrame], name: str
) -> tuple[Callable[[DataFrame, int], None], str]:
    """A batch handler that expands new detections and records which drawings they replace.

    With an `upload_id` the rows of an upload may come in several batches, and the
    greatest id of a drawing counts; without one each batch is an upload. Rows without project, drawing or id belong to no
    upload. The rows of a batch are read once for their ids and once to be expanded, and not kept between.
    """
    path = new_path(spark, f"lines-{name}")
    ids = ("project_id", "drawing_id", "upload_id")

    def handle(batch: DataFrame, batch_id: int) -> None:
        upload = F.col("upload_id").cast("long") if "upload_id" in batch.columns else F.lit(batch_id).cast("long")
        batch = batch.withColumn("upload_id", upload).dropna(subset=ids)
        scopes, mixed = f"{path}/scope/batch_id={batch_id}", f"{path}/several/batch_id={batch_id}"
        scope = batch.groupBy("project_id", "drawing_id").agg(F.max("upload_id").alias("upload_id"), F.min("upload_id").alias("first_id"))
        scope.write.mode("overwrite").parquet(scopes)
        several = spark.read.schema(scope.schema).parquet(scopes).where("first_id < upload_id").select(*ids)
        several.write.mode("overwrite").parquet(mixed)
        newest = newest_rows(batch, spark.read.schema(several.schema).parquet(mixed)).drop("upload_id")
        expand(newest).write.mode("overwrite").parquet(f"{path}/lines/batch_id={batch_id}")

    return handle, path


def current_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of the last upload of each drawing, from all batches it came in; a
    drawing whose last upload gave no lines has none."""
    columns = "project_id long, drawing_id long, upload_id long, batch_id long"
    scope = spark.read.schema(columns).parquet(f"{path}/scope")
    last = scope.groupBy("project_id", "drawing_id").agg(F.max("upload_id").alias("upload_id"))
    newest = scope.join(last, ["project_id", "drawing_id", "upload_id"], "left_semi").drop("upload_id")
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    lines = spark.read.schema(stored).parquet(f"{path}/lines")
    return lines.join(newest, ["project_id", "drawing_id", "batch_id"], "left_semi").drop("batch_id")
