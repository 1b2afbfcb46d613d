"""Orphans are counted in as many tasks as the rows ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import quality


def test_tasks_grow_with_the_rows(spark):
    children = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("ref"))
    parents = spark.range(0, 10_000, 2)
    found = quality.orphans(children, "ref", parents, "id", "x", rows_per_task=500)  # 9933 rows
    want = {str(i): 1 for i in range(1, 10_000, 2) if i % 3 and i % 100 != 1} | {"7": 1 + 3334}
    assert {r["key"]: r["rows"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 20), REPARTITION_BY_NUM" in plan
