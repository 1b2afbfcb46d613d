"""Cost roll-up, snapshots of it, and their history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import money
from tallyspark.functions.web import version_label
from tallyspark.operators.boq import project_totals
from tallyspark.operators.ordered import fitting_time_block, neighbours, running_totals
from tallyspark.rules import RULESET_VERSION


@dataclass(frozen=True)
class CostParameters:
    """Fixed default shares of the materials total, and percentages on the subtotal."""

    labour: float = 0.35
    transport: float = 0.05
    overheads: float = 0.08
    markup_pct: float = 15.0
    contingency_pct: float = 5.0


def cost_columns(materials: Column, p: CostParameters = CostParameters()) -> dict[str, Column]:
    """Every figure rounded from unrounded parts."""
    labour = materials * F.lit(p.labour)
    transport = materials * F.lit(p.transport)
    overheads = materials * F.lit(p.overheads)
    subtotal = materials + labour + transport + overheads
    markup = subtotal * F.lit(p.markup_pct / 100)
    contingency = subtotal * F.lit(p.contingency_pct / 100)
    return {
        "materials_total": money(materials),
        "labour_total": money(labour),
        "transport_total": money(transport),
        "overheads_total": money(overheads),
        "subtotal": money(subtotal),
        "markup_amount": money(markup),
        "contingency_amount": money(contingency),
        "total": money(subtotal + markup + contingency),
    }


def cost_rollup(
    totals: DataFrame, p: CostParameters = CostParameters(), keep: Sequence[str] = ()
) -> DataFrame:
    """Cost build-up per project from its materials total (`project_id`, `total`)."""
    figures = cost_columns(F.col("total"), p)
    return totals.select("project_id", *keep, *[c.alias(n) for n, c in figures.items()])


def breakdown(summary: DataFrame) -> DataFrame:
    """Trade totals of a project as one JSON text, largest first.

    The list has one entry per trade of the project, whatever its lines.
    """
    entry = F.struct((-F.col("total")).alias("k"), "trade", money(F.col("total")).alias("total"), "count")
    listed = summary.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    plain = F.transform(
        "rows", lambda r: F.struct(r["trade"].alias("trade"), r["total"].alias("total"), r["count"].alias("count"))
    )
    return listed.select("project_id", F.to_json(plain).alias("breakdown"))


def cost_snapshot(
    summary: DataFrame,
    at: datetime,
    p: CostParameters = CostParameters(),
    ruleset_version: str = RULESET_VERSION,
) -> DataFrame:
    """Rows to append to the cost versions, one per project."""
    clock = F.lit(at)
    figures = cost_rollup(project_totals(summary), p)
    return figures.join(breakdown(summary), "project_id").select(
        "project_id",
        version_label(clock).alias("version_label"),
        F.lit(ruleset_version).alias("ruleset_version"),
        *figures.columns[1:],
        F.lit(p.markup_pct).alias("markup_pct"),
        F.lit(p.contingency_pct).alias("contingency_pct"),
        "breakdown",
        clock.alias("created_at"),
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each project, by partial aggregation."""
    newest = F.max_by(F.struct("id", "version_label", "total", "created_at"), F.struct("created_at", "id"))
    return (
        versions.groupBy("project_id")
        .agg(newest.alias("v"), F.count("*").alias("versions"))
        .select("project_id", "versions", "v.*")
    )


def version_history(versions: DataFrame, seconds: int | None = None) -> DataFrame:
    """Versions numbered from the newest on, the newest marked as active.

    Numbered from the oldest in time blocks and turned round by the number of
    versions, so a project with very many versions is spread over its blocks.
    """
    counted = running_totals(
        versions,
        ["project_id"],
        [F.col("created_at"), F.col("id")],
        fitting_time_block(versions, "created_at", seconds),
        {"n": F.lit(1).cast("long")},
        whole=True,
    )
    return counted.select(
        *versions.columns,
        (F.col("n_whole") - F.col("n") + 1).alias("position"),
        (F.col("n_whole") == F.col("n")).alias("active"),
    )


def version_changes(versions: DataFrame, seconds: int | None = None) -> DataFrame:
    """Difference of each version's total from the version before it."""
    near = neighbours(
        versions,
        ["project_id"],
        ["created_at", "id"],
        fitting_time_block(versions, "created_at", seconds),
        previous={"total": "previous_total"},
    )
    return near.withColumn("change", money(F.col("total") - F.col("previous_total")))


def rate_history(rates: DataFrame, seconds: int | None = None) -> DataFrame:
    """Validity ranges of material rates: previous rate, and valid until the next one.

    Takes (material_id, valid_from, rate) with one row per material and time.
    """
    near = neighbours(
        rates,
        ["material_id"],
        ["valid_from"],
        fitting_time_block(rates, "valid_from", seconds),
        previous={"rate": "previous_rate"},
        following={"valid_from": "valid_to"},
    )
    return near.withColumn("is_current", F.col("valid_to").isNull())
