"""Block-wise windows equal plain windows, also for a key that holds most rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators.ordered import id_block, neighbours, numbered, running_totals, time_block
from tallyspark.operators.textmatch import contains_pairs


@pytest.fixture(scope="module")
def rows(spark):
    # one third of all rows in key 0, gaps in the ids, values with nulls
    return spark.range(0, 30_000, 3).select(
        F.when(F.col("id") % 9 < 3, 0).otherwise(F.col("id") % 50).alias("k"),
        F.col("id"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 31 % 101).alias("v"),
        F.timestamp_seconds(F.col("id") * 977).alias("ts"),
    )


def same(left, right):
    assert left.count() == right.count()
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("width", [7, 1_000, 10_000_000])
def test_numbers(rows, width):
    got = numbered(rows, ["k"], [F.col("id")], id_block("id", width), "n")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("long"))
    same(got, want)


def test_running_totals_and_whole(rows):
    base = rows.withColumn("v", F.coalesce("v", F.lit(0)))
    got = running_totals(base, ["k"], [F.col("ts")], time_block("ts", 86_400), {"s": F.col("v")}, whole=True)
    w = Window.partitionBy("k")
    want = base.withColumn("s", F.sum("v").over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "s_whole", F.sum("v").over(w)
    )
    same(got, want)


@pytest.mark.parametrize("width", [5, 500])
def test_neighbours(rows, width):
    got = neighbours(
        rows, ["k"], ["id"], id_block("id", width), previous={"v": "pv", "id": "pid"}, following={"v": "nv"}
    )
    w = Window.partitionBy("k").orderBy("id")
    want = rows.select("*", F.lag("v").over(w).alias("pv"), F.lag("id").over(w).alias("pid"), F.lead("v").over(w).alias("nv"))
    same(got, want)


def test_blocks_split_a_hot_key(rows):
    """No window of the plan runs on the key alone over the rows."""
    got = numbered(rows, ["k"], [F.col("id")], id_block("id", 1_000), "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan.split("hashpartitioning(")[1].split(")")[0] or "_block" in plan


def test_contains_pairs_equal_brute_force(spark):
    texts = ["saint gobain glass 10mm", "glass", "ring seal", "a", "ab", "", None, "gear ring", "ring ring"]
    patterns = ["glass", "ring", "a", "ab", "b g", "zzz", "", "ring ring", "s"]
    got = contains_pairs(
        spark.createDataFrame([(t,) for t in texts], "text string"),
        spark.createDataFrame([(p,) for p in patterns], "pattern string"),
    )
    want = {(t, p) for t in texts if t is not None for p in patterns if p and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
