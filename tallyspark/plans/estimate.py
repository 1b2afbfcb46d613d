"""The whole estimate of all projects: lines, costs and findings from one pass over the objects."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import boq, costing, diagnostics, maintenance
from tallyspark.operators.expand import expand_with
from tallyspark.rules import RuleSet
from tallyspark.session import new_path
from tallyspark.sources import snapshots

BUCKETS = 64


def estimate(
    objects: DataFrame,
    projects: DataFrame,
    rule_set: RuleSet,
    parameters: costing.CostParameters = costing.CostParameters(),
    buckets: int = BUCKETS,
) -> Mapping[str, DataFrame]:
    """Bill lines, trade summary, costs and findings.

    The objects are expanded once and the lines stored by project bucket; the
    trade summary, one row per project and trade, is stored too. Everything else
    reads the summary, so no result recomputes the expansion and a lost executor
    costs a re-read.
    """
    spark = objects.sparkSession
    expanded = expand_with(objects, rule_set)
    lines_path, summary_path = new_path(spark, "boq-items"), new_path(spark, "trade-summary")
    maintenance.write_bucketed(expanded, lines_path, buckets)
    lines = maintenance.read_bucketed(spark, lines_path, expanded.schema)
    summed = boq.trade_summary(lines)
    summed.write.parquet(summary_path)
    summary = spark.read.schema(summed.schema).parquet(summary_path)
    return {
        "lines": lines,
        "summary": summary,
        "costs": costing.cost_rollup(boq.project_totals(summary), parameters, keep=("trades", "lines")),
        "missing": diagnostics.missing_trades(projects, summary),
        "outliers": diagnostics.trade_outliers(summary),
        "savings": diagnostics.value_engineering(summary),
    }


def overview(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per project with lines: its cost and how many findings it has."""

    def counted(name: str) -> DataFrame:
        return parts[name].groupBy("project_id").agg(F.count("*").alias(name))

    saving = parts["savings"].where(F.col("rank") == 1).select("project_id", "total_saving")
    joined = (
        parts["costs"]
        .join(counted("missing"), "project_id", "left")
        .join(counted("outliers"), "project_id", "left")
        .join(saving, "project_id", "left")
    )
    return joined.select(
        "project_id",
        "trades",
        "lines",
        "materials_total",
        "total",
        F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
        F.coalesce("outliers", F.lit(0)).cast("long").alias("outliers"),
        "total_saving",
    )


def create_store(spark: SparkSession, root: str, lines: DataFrame, projects: DataFrame, rows_per_bucket: int = snapshots.ROWS_PER_BUCKET) -> int:
    """A store with the bill lines and the projects, each in buckets by project."""
    commit = snapshots.begin(spark, root)
    commit.create("lines", lines, "project_id", rows_per_bucket=rows_per_bucket)
    commit.create("projects", projects, "id", rows_per_bucket=rows_per_bucket)
    return commit.finish()


def replace_lines(spark: SparkSession, root: str, new: DataFrame, scope: DataFrame, at: datetime) -> int:
    """Exchange the lines of the projects in scope, touch these projects and append their cost versions, in one commit.

    Projects whose new bill is empty lose their lines and get no version.
    """
    commit = snapshots.begin(spark, root)
    commit.replace("lines", new, scope)
    touched = scope.select(F.col("project_id").alias("id")).distinct().withColumn("_at", F.lit(at))
    projects = snapshots.read(spark, root, "projects").join(touched, "id")
    moved = projects.withColumn("updated_at", F.greatest("updated_at", F.col("_at").cast(projects.schema["updated_at"].dataType))).drop("_at")
    commit.replace("projects", moved, touched)
    versions = costing.cost_snapshot(boq.trade_summary(new), at)
    if "versions" in commit.tables:
        commit.append("versions", versions)
    else:
        commit.create("versions", versions, "project_id", buckets=commit.tables["lines"].buckets)
    return commit.finish()
