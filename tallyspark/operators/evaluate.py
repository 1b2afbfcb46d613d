"""Checking results against expectations: tolerances, counts, budgets, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.formulas import evaluate
from tallyspark.functions.numbers import cents, deviation_pct, from_cents, money, sum_money, sum_quantity


def truth_totals(trades: DataFrame, key: str = "project_id") -> DataFrame:
    """Total of a nested bill: each trade counts its computed total when the field is
    there, a null one as nothing, else its expected total, else nothing."""
    amount = F.coalesce(F.when(F.col("computed_given"), F.col("computed_total")).otherwise(F.col("expected_total")), F.lit(0.0))
    return trades.groupBy(key).agg(
        sum_money(amount).alias("total"), F.count_if(F.col("trade").isNotNull()).alias("trades")
    )


def real_items(items: DataFrame) -> DataFrame:
    """Items with an amount; header rows have none."""
    return items.where(F.col("amount") > 0)


def tolerance_gate(compared: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Deviation of `actual` from `expected` and whether it is within tolerance."""
    delta = deviation_pct(F.col("actual"), F.col("expected"))
    return compared.withColumn("delta_pct", delta).withColumn("passed", F.col("delta_pct") <= tolerance_pct)


def structure_check(counts: DataFrame, trades_expected: int = 13, items_expected: int = 96) -> DataFrame:
    """Flags on the number of trades and items (`trades`, `items`, `delta_pass`).

    The item flag is reported but does not decide.
    """
    return counts.withColumns(
        {
            "trades_pass": F.col("trades") == trades_expected,
            "items_pass": F.col("items") == items_expected,
        }
    ).withColumn("passed", F.col("delta_pass") & F.col("trades_pass"))


def structure_counts(items: DataFrame, key: str) -> DataFrame:
    """Different trades and all items per key, by two light aggregations."""
    return (
        items.groupBy(key, "trade")
        .agg(F.count("*").alias("n"))
        .groupBy(key)
        .agg(F.count("*").alias("trades"), F.sum("n").alias("items"))
    )


def budget_estimates(
    items: DataFrame, formulas: Sequence[str], variables: Mapping[str, Column], key: str = "fixture"
) -> DataFrame:
    """Sum of formula quantity times rate per key, rounded once at the end."""
    quantity = evaluate(F.col("formula"), formulas, variables)
    return items.groupBy(key).agg(money(sum_quantity(quantity * F.col("rate"))).alias("estimate"))


def budget_verdicts(
    estimates: DataFrame,
    reference_total: float = 6_251_940.0,
    reference_area: float = 1_900.0,
    low: float = 0.4,
    high: float = 1.6,
) -> DataFrame:
    """Compare an estimate with its budget range, then with a band around the
    estimate scaled by area. Rounding is to even, the bounds are cut to whole."""
    scaled = F.bround(F.lit(reference_total) * (F.col("area") / F.lit(reference_area)), 0).cast("long")
    lower = (scaled * F.lit(low)).cast("long")
    upper = (scaled * F.lit(high)).cast("long")
    return (
        estimates.withColumn("estimated", F.bround("estimate", 0).cast("long"))
        .withColumn("scaled_estimate", scaled)
        .withColumn("scaled_low", lower)
        .withColumn("scaled_high", upper)
        .withColumn(
            "verdict",
            F.when(F.col("estimate").between(F.col("low_budget"), F.col("high_budget")), "in range")
            .when(F.col("estimate").between(F.col("scaled_low"), F.col("scaled_high")), "in scaled range")
            .otherwise("out of range"),
        )
    )


def scenario_rollup(scenarios: DataFrame, key: str) -> DataFrame:
    """Overall verdict from scenario rows (`passed`, `skipped`, `errors`)."""
    rolled = scenarios.groupBy(key).agg(
        F.count("*").alias("scenarios"),
        F.bool_and("passed").alias("all_passed"),
        F.bool_or("skipped").alias("any_skipped"),
        F.sum("errors").alias("errors"),
    )
    return rolled.withColumn(
        "verdict",
        F.when(F.col("all_passed") & F.col("any_skipped"), "partial")
        .when(F.col("all_passed"), "validated")
        .when(F.col("errors") > 0, "error")
        .when(F.col("any_skipped"), "structural failure")
        .otherwise("overfit"),
    )


def compare_counts(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected and observed counts side by side, with 0 for the side that lacks a key."""
    joined = expected.select(*keys, F.col("n").alias("expected")).join(
        observed.select(*keys, F.col("n").alias("observed")), list(keys), "full_outer"
    )
    e, o = (F.coalesce(c, F.lit(0)).cast("long") for c in ("expected", "observed"))
    return joined.select(
        *keys, e.alias("expected"), o.alias("observed"), (o - e).alias("difference"), (o == e).alias("matches")
    )


def detection_quality(compared: DataFrame, by: str) -> DataFrame:
    """Precision, recall and F1 per category from counts: the smaller of expected
    and observed is taken as found."""
    sums = compared.groupBy(by).agg(
        F.sum(F.least("expected", "observed")).alias("found"),
        F.sum("expected").alias("expected"),
        F.sum("observed").alias("observed"),
    )
    found = F.col("found").cast("double")
    return sums.select(
        by,
        "expected",
        "observed",
        "found",
        F.try_divide(found, F.col("observed").cast("double")).alias("precision"),
        F.try_divide(found, F.col("expected").cast("double")).alias("recall"),
        F.try_divide(found * 2, (F.col("observed") + F.col("expected")).cast("double")).alias("f1"),
    )


def area_check(rooms: DataFrame, stated: DataFrame, key: str, tolerance_pct: float = 5.0) -> DataFrame:
    """Sum of detected areas against the area stated for the drawing."""
    sums = rooms.groupBy(key).agg(sum_quantity(F.col("area")).alias("actual"))
    joined = stated.select(key, F.col("area").alias("expected")).join(sums, key, "left")
    return tolerance_gate(joined.withColumn("actual", F.coalesce("actual", F.lit(0.0))), tolerance_pct)


def _sides(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each value of either side once, flagged by the sides that have it.

    One aggregation over both sides: repeated values are reduced before they are
    shuffled, which set operations by semi or anti join do not do.
    """
    both = left.select(*columns, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(*columns, F.lit(False).alias("l"), F.lit(True).alias("r"))
    )
    return both.groupBy(*columns).agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))


def reconcile(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values only one side has; nothing is left over when the sets agree."""
    return _sides(expected, actual, columns).where(F.col("l") != F.col("r")).select(
        *columns, F.when(F.col("l"), "missing").otherwise("unexpected").alias("side")
    )


def overlap(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _sides(left, right, columns).where(F.col("l") & F.col("r")).select(*columns)


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _sides(left, right, columns).where(F.col("l") & ~F.col("r")).select(*columns)


def status_counts(log: DataFrame, status: str = "status") -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("n"))


def run_spend(usage: DataFrame) -> DataFrame:
    """First iteration of each run, and the calls and spend of all of them."""
    first = F.min_by(F.struct("calls", "spend"), F.struct("iteration", "entry_id"))
    return usage.groupBy("run_id").agg(
        first.alias("f"), F.sum("calls").alias("calls"), F.sum(cents(F.col("spend"))).alias("c")
    ).select(
        "run_id",
        F.col("f.calls").alias("first_calls"),
        F.col("f.spend").alias("first_spend"),
        "calls",
        from_cents(F.col("c")).alias("spend"),
    )


def check_report(scenarios: DataFrame, key: str) -> DataFrame:
    """Each key's checks as one JSON text; a key has as many entries as it has checks."""
    entry = F.struct("name", "passed", "errors")
    listed = scenarios.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("checks"))
    return listed.select(
        key,
        F.to_json(
            F.struct(
                F.forall("checks", lambda c: c["passed"]).alias("passed"),
                F.size("checks").alias("checks_run"),
                F.col("checks").alias("checks"),
            )
        ).alias("report"),
    )
