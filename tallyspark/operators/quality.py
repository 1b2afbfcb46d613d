"""Checks of stored data; each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schema as S

# File types taken for drawings, their size limits and first bytes.
UPLOAD_TYPES = ("dxf", "pdf", "png", "jpg", "jpeg", "tiff")
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_REQUEST_BYTES = 10 * 1024 * 1024
FIRST_BYTES = {
    "pdf": ("25504446",),
    "png": ("89504E47",),
    "jpg": ("FFD8FF",),
    "jpeg": ("FFD8FF",),
    "tiff": ("49492A00", "4D4D002A"),
}

# Fixed pattern: tax number of a vendor (state, holder, entity, check character).
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for every rule a row breaks; a null condition is no violation.

    One pass over the table for all rules.
    """
    broken = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("rule"))


def outside(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def state_violations(projects: DataFrame, drawings: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows of the stored tables whose state is none of the allowed ones."""
    parts = [
        violations(projects, "id", {"project status": outside("status", S.PROJECT_STATUSES)}),
        violations(drawings, "id", {"drawing status": outside("status", S.DRAWING_STATUSES)}),
        violations(
            objects,
            "id",
            {
                "detection source": outside("detection_source", S.DETECTION_SOURCES),
                "confidence": ~F.col("confidence").between(0, 1),
            },
        ),
    ]
    return all_of(parts)


def duplicated(df: DataFrame, column: str, rule: str) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > 1).select(
        F.col(column).cast("string").alias("key"), F.lit(rule).alias("rule")
    )


ROWS_PER_TASK = 1_000_000
SPREAD = 16


def orphans(
    children: DataFrame, reference: str, parents: DataFrame, parent_key: str, name: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Reference values without a parent row, with the number of child rows.

    Keys are dealt to as many tasks as the child rows ask for, so a task holds at most about `rows_per_task`
    of them; rows of a key that very many share are counted in up to `SPREAD` tasks first.
    """
    held = children.where(F.col(reference).isNotNull()).select(F.col(reference).alias("key"))
    tasks = max(1, -(-held.count() // rows_per_task))
    spread = held.withColumn("_part", F.spark_partition_id() % SPREAD).repartition(tasks, "key", "_part")
    counted = spread.groupBy("key", "_part").agg(F.count("*").alias("n"))
    used = counted.repartition(tasks, "key").groupBy("key").agg(F.sum("n").alias("rows"))
    known = parents.select(F.col(parent_key).alias("key"))
    return used.join(known, "key", "left_anti").select(
        F.lit(name).alias("reference"), F.col("key").cast("string").alias("key"), "rows"
    )


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def master_data_violations(
    materials: DataFrame, vendors: DataFrame, wastage: DataFrame, labour_rates: DataFrame
) -> DataFrame:
    """Checks of catalogue, vendors, wastage and labour tables in one result."""
    parts = [
        duplicated(materials, "sku", "sku not unique"),
        violations(materials, "id", {"rate not positive": ~(F.col("rate") > 0)}),
        orphans(materials, "vendor_name", vendors, "name", "").select(
            "key", F.lit("vendor unknown").alias("rule")
        ),
        duplicated(vendors, "name", "vendor not unique"),
        violations(vendors, "id", {"tax number malformed": ~F.col("gst").rlike(GSTIN)}),
        violations(
            wastage, "material_name", {"wastage outside 0 to 100": ~F.col("wastage_pct").between(0, 100)}
        ),
        violations(labour_rates, "trade", {"productivity not positive": ~(F.col("productivity") > 0)}),
    ]
    return all_of(parts)


def upload_problems(manifest: DataFrame) -> DataFrame:
    """Why a file would be refused; needs (path, length, head) with head in hex."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wrong_start = F.lit(False)
    for kind, starts in FIRST_BYTES.items():
        good = reduce(lambda a, b: a | b, [F.startswith(F.upper("head"), F.lit(s)) for s in starts])
        wrong_start = wrong_start | ((F.col("extension") == kind) & ~good)
    return violations(
        manifest.withColumn("extension", extension),
        "path",
        {
            "type not allowed": ~F.col("extension").isin(*UPLOAD_TYPES),
            "file too large": F.col("length") > MAX_FILE_BYTES,
            "request too large": F.col("length") > MAX_REQUEST_BYTES,
            "content does not fit type": wrong_start,
        },
    )


def run_log_problems(runs: DataFrame, source: str = "pdf") -> DataFrame:
    """Runs that may not be used as evidence: wrong source, or no model calls."""
    return violations(
        runs,
        "run_id",
        {
            "source not accepted": F.coalesce(F.col("source") != source, F.lit(True)),
            "no calls made": F.coalesce("calls", F.lit(0)) == 0,
        },
    )
