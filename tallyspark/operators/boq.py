"""Reading a bill: defaults, trade summary, totals, numbering and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents, from_cents, money, sum_money
from tallyspark.operators.ordered import id_block, numbered

NO_TRADE = "Misc"


def bill_lines(lines: DataFrame) -> DataFrame:
    """Lines with the defaults of a bill response; a missing trade stays missing."""
    zero = F.lit(0.0)
    return lines.select(
        "id",
        "project_id",
        "description",
        F.coalesce(F.col("quantity").cast("double"), zero).alias("quantity"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce(F.col("rate").cast("double"), zero).alias("rate"),
        F.coalesce(F.col("total").cast("double"), zero).alias("total"),
        "trade",
        "material_id",
        "material_name",
        "location",
    )


def scoped(df: DataFrame, **equal: object) -> DataFrame:
    """Keep rows equal to every condition that was given; None means no condition."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def trade_name(trade: str = "trade") -> Column:
    return F.coalesce(F.col(trade), F.lit(NO_TRADE))


def trade_summary(lines: DataFrame, first_seen: str | None = None) -> DataFrame:
    """Total and number of lines per project and trade, over all lines."""
    aggregates = [sum_money(F.coalesce("total", F.lit(0.0))).alias("total"), F.count("*").alias("count")]
    if first_seen:
        aggregates.append(F.min(first_seen).alias("first_id"))
    return lines.groupBy("project_id", trade_name().alias("trade")).agg(*aggregates)


def project_totals(summary: DataFrame) -> DataFrame:
    """Grand total, trades and lines per project from the trade summary."""
    return summary.groupBy("project_id").agg(
        sum_money(F.col("total")).alias("total"),
        F.count("*").alias("trades"),
        F.sum("count").alias("lines"),
    )


def lump_sum_total(quantity: Column, unit: Column, rate: Column) -> Column:
    """The rate itself for lump-sum lines, else quantity times rate."""
    return F.when(F.upper(unit) == "LS", rate.cast("double")).otherwise(money(quantity * rate))


def line_numbers(lines: DataFrame, block_width: int = 1_000_000) -> DataFrame:
    """Number the lines of each project and trade in id order."""
    named = lines.withColumn("trade", trade_name())
    return numbered(
        named, ["project_id", "trade"], [F.col("id")], id_block("id", block_width), "line_number"
    )


def sections(lines: DataFrame) -> DataFrame:
    """Subtotal per trade and grand total per project in one table.

    Built on the trade summary, so the lines are shuffled once.
    """
    summary = trade_summary(lines)
    named = summary.select("project_id", "trade", "count", cents(F.col("total")).alias("c"))
    return (
        named.rollup("project_id", "trade")
        .agg(F.sum("c").alias("c"), F.sum("count").alias("lines"), F.grouping_id().alias("level"))
        .where(F.col("project_id").isNotNull())
        .select(
            "project_id",
            F.when(F.col("level") == 0, F.col("trade")).otherwise(F.lit("Grand Total")).alias("section"),
            F.col("level").cast("int").alias("level"),
            "lines",
            from_cents(F.col("c")).alias("total"),
        )
    )


def trade_groups(lines: DataFrame, contains: str = "") -> DataFrame:
    """Trade summary limited to trades whose name holds a text, any case."""
    summary = trade_summary(lines)
    if contains:
        summary = summary.where(F.contains(F.lower("trade"), F.lit(contains.lower())))
    return summary


def trade_shares(summary: DataFrame) -> DataFrame:
    """Share of the project total and bar length against the largest trade.

    The windows run over trade rows, at most one per trade and project.
    """
    project = Window.partitionBy("project_id")
    whole = from_cents(F.sum(cents(F.col("total"))).over(project))
    largest = F.greatest(F.max("total").over(project), F.lit(1.0))
    return summary.select(
        "project_id",
        "trade",
        "total",
        F.try_divide(F.col("total"), whole).alias("share"),
        largest.alias("largest"),
        F.greatest(F.lit(2.0), F.col("total") / largest * F.lit(100.0)).alias("bar_pct"),
    )


def distinct_trades(lines: DataFrame) -> DataFrame:
    """Number of different trades per project; a missing trade counts as one.

    Two aggregations, so a hot project is first reduced to its trades.
    """
    return (
        lines.select("project_id", "trade")
        .distinct()
        .groupBy("project_id")
        .agg(F.count("*").alias("trades"))
    )


def in_group_order(summary: DataFrame, first_id: str = "first_id") -> DataFrame:
    """Position of each trade by its first line in the bill."""
    order = Window.partitionBy("project_id").orderBy(first_id)
    return summary.withColumn("position", F.row_number().over(order).cast("long"))


def top_trades(summary: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.desc("total"), "trade")
    return summary.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
