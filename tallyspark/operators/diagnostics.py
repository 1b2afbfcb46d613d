"""Findings on a priced bill: gaps, outliers, savings, and its text summary.

All of them start from the trade summary, which has one row per project and
trade; the lines themselves are aggregated only once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents, from_cents, half_up, indian_digits
from tallyspark.operators.boq import top_trades
from tallyspark.rules import TYPICAL_TRADES

# Fixed texts of findings; {} stands for the trade.
RUPEE = "₹"
MISSING_REASON = "No items detected in {}. Typical interior fit-out includes this trade."
SAVING_SHARE = 0.05
SAVING_CHANGE = "Switch one premium material in {} to a standard alternative (~5% saving)."


def _filled(text: str) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), F.col("trade"), F.lit(after))


def missing_trades(
    projects: DataFrame, summary: DataFrame, typical: Sequence[str] = TYPICAL_TRADES
) -> DataFrame:
    """Usual trades a project has no lines in, with a suggested entry.

    Each project keeps a set of at most the usual trades, so neither a cross
    join nor an anti join is needed.
    """
    usual = F.array(*[F.lit(t) for t in typical])
    present = summary.groupBy("project_id").agg(
        F.collect_set(F.when(F.col("trade").isin(*typical), F.col("trade"))).alias("present")
    )
    gaps = projects.select(F.col("id").alias("project_id")).join(present, "project_id", "left").select(
        "project_id",
        F.explode(F.array_except(usual, F.coalesce("present", F.array().cast("array<string>")))).alias("trade"),
    )
    return gaps.select(
        "project_id",
        "trade",
        _filled(MISSING_REASON).alias("reason"),
        F.lit(1).cast("long").alias("suggested_qty"),
        F.lit("lot").alias("unit"),
    )


def with_trade_average(summary: DataFrame) -> DataFrame:
    """Average trade total of the project beside each trade row."""
    project = Window.partitionBy("project_id")
    whole = from_cents(F.sum(cents(F.col("total"))).over(project))
    return summary.withColumn("average", whole / F.count("*").over(project))


def trade_outliers(summary: DataFrame, factor: float = 3.0, high_factor: float = 5.0) -> DataFrame:
    """Trades far above the average trade of their project."""
    found = with_trade_average(summary).where(F.col("total") > F.col("average") * factor)
    return found.select(
        "project_id",
        "trade",
        F.concat(
            F.col("count").cast("string"), F.lit(f" items, {RUPEE}"), indian_digits(F.col("total"), rounded=True)
        ).alias("line"),
        half_up(F.col("average")).alias("expected"),
        half_up(F.col("total")).alias("got"),
        F.when(F.col("total") > F.col("average") * high_factor, "high").otherwise("med").alias("severity"),
    )


def absolute_outliers(summary: DataFrame, limit: float = 700_000.0, high: float = 1_500_000.0) -> DataFrame:
    """Trades above a fixed amount."""
    found = with_trade_average(summary).where(F.col("total") > limit)
    return found.select(
        "project_id",
        "trade",
        half_up(F.col("average")).alias("expected"),
        half_up(F.col("total")).alias("got"),
        F.when(F.col("total") > high, "high").otherwise("med").alias("severity"),
    )


def value_engineering(summary: DataFrame, k: int = 3, share: float = SAVING_SHARE) -> DataFrame:
    """A saving on each of the largest trades; the sum is rounded from unrounded parts."""
    top = top_trades(summary, k).withColumn("part", F.col("total") * F.lit(share))
    project = Window.partitionBy("project_id").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return top.select(
        "project_id",
        "rank",
        "trade",
        _filled(SAVING_CHANGE).alias("change"),
        half_up(F.col("part")).alias("saving"),
        half_up(F.sum("part").over(project)).alias("total_saving"),
    )


def bill_context(summary: DataFrame, order: str = "first_id", citations: int = 5) -> DataFrame:
    """One text per project with a line per trade, and quotes of the first trades.

    The collected list has one entry per trade of the project.
    """
    amount = F.concat(F.lit(f": {RUPEE}"), indian_digits(F.col("total"), rounded=True))
    entry = F.struct(
        F.col(order).alias("k"),
        F.concat("trade", amount, F.lit(" ("), F.col("count").cast("string"), F.lit(" items)")).alias("text"),
        F.concat("trade", F.lit(f" total {RUPEE}"), indian_digits(F.col("total"), rounded=True)).alias("quote"),
    )
    listed = summary.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    return listed.select(
        "project_id",
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("context"),
        F.transform(F.slice("rows", 1, citations), lambda r: r["quote"]).alias("citations"),
    )
