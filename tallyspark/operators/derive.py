"""Tracing lines back to rules and objects, and maintained project figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derivations(lines: DataFrame, rules: DataFrame, objects: DataFrame) -> DataFrame:
    """Each line with the rule that made it and the object it came from.

    A line has one source object, so the block is built per row and nothing is
    collected.
    """
    rule = rules.select(
        F.col("id").alias("rule_id"), F.col("key").alias("rule_key"), F.col("material").alias("rule_description")
    )
    source = objects.select(F.col("id").alias("detected_object_id"), "object_type", "quantity_estimate")
    joined = lines.join(rule, "rule_id", "left").join(source, "detected_object_id", "left")
    block = F.struct(
        F.col("rule_key").alias("rule_id"),
        F.col("rule_description"),
        F.when(
            F.col("object_type").isNotNull(),
            F.array(
                F.struct(
                    F.col("object_type"), F.col("detected_object_id").alias("id"), F.col("quantity_estimate").alias("area")
                )
            ),
        ).alias("source_objects"),
    )
    return joined.select("id", "project_id", "total", F.to_json(block).alias("derivation"))


def project_figures(projects: DataFrame, drawings: DataFrame, totals: DataFrame) -> DataFrame:
    """Number of drawings and current total of every project."""
    counts = drawings.groupBy("project_id").agg(F.count("*").alias("drawings_count"))
    return (
        projects.select(F.col("id").alias("project_id"))
        .join(counts, "project_id", "left")
        .join(totals.select("project_id", "total"), "project_id", "left")
        .select("project_id", F.coalesce("drawings_count", F.lit(0)).cast("long").alias("drawings_count"), "total")
    )


def portfolio(projects: DataFrame, by: str | None = None) -> DataFrame:
    """Project counts: all, in work, sent, and with drawings."""
    grouped = projects.groupBy(by) if by else projects.groupBy()
    return grouped.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin("in_progress", "priced")).alias("in_progress"),
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("drawings_count") > 0).alias("with_drawings"),
    )
