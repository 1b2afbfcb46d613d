"""Cases that lost or invented data before."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import formulas
from tallyspark.functions.numbers import sum_quantity
from tallyspark.operators import boq, evaluate, expand, export, ingest, materials
from tallyspark.rules import RuleSet, keyword_overrides


def test_small_quantities_add_up(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.lit(0.004).alias("q"))
    assert rows.groupBy("k").agg(sum_quantity(F.col("q")).alias("q")).first().q == 4.0
    lines = rows.select(F.lit(1).alias("project_id"), F.lit("m").alias("material_name"), F.col("q").alias("quantity"), F.lit(0.0).alias("total"))
    assert materials.materials_summary(lines).first().quantity == 4.0


def test_estimates_are_rounded_once(spark):
    items = spark.range(1000).select(F.lit("f").alias("fixture"), F.lit("a * 1").alias("formula"), F.lit(0.004).alias("rate"), F.lit(1.0).alias("a"))
    assert evaluate.budget_estimates(items, ["a * 1"], {"a": F.col("a")}).first().estimate == 4.0


def test_null_keys_and_ids_are_numbered(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (None, 1, "a"), (2, None, "a"), (3, None, None)], "id long, project_id long, trade string")
    got = {(r.id, r.project_id, r.trade): r.line_number for r in boq.line_numbers(lines).collect()}
    assert got == {(None, 1, "a"): 1, (1, 1, "a"): 2, (2, None, "a"): 1, (3, None, "Misc"): 1}


def test_many_formulas(spark):
    texts = [f"a + {i}" for i in range(1000)]
    rows = spark.range(0, 1000, 37).select(F.concat(F.lit("a + "), F.col("id").cast("string")).alias("formula"), F.lit(1.0).alias("a"), "id")
    got = rows.select("id", formulas.evaluate(F.col("formula"), texts, {"a": F.col("a")}).alias("v")).collect()
    assert got and all(r.v == r.id + 1 for r in got)
    assert rows.select(formulas.evaluate(F.lit("none"), texts, {"a": F.col("a")}).alias("v")).first().v == 0.0


def test_results_beyond_all_numbers_are_zero(spark):
    row = spark.range(1).select(F.lit(0.0).alias("b"), F.lit(1e200).alias("h"))
    known = {"b": F.col("b"), "h": F.col("h")}
    values = row.select(*[formulas.compile_formula(f, known).alias(f"v{i}") for i, f in enumerate(("b ** -1", "h * h", "ceil(h)"))]).first()
    assert list(values) == [0.0, 0.0, 1e200]


def test_overrides_do_not_depend_on_their_number(spark):
    fields = "priority int, key string, trade string, unit string, rate double, material string, per_area int"
    some = [(2, "ab", "T2", "nos", 1.0, "m", 0), (2, "aa", "T1", "nos", 1.0, "m", 0), (1, "", "T0", "nos", 1.0, "m", 0)]
    objects = spark.createDataFrame(
        [(1, 1, "room", "aab"), (2, 1, "room", "xAB"), (3, 1, "room", None), (4, 1, "door", "aa")],
        "id long, drawing_id long, object_type string, label string",
    )
    overrides = spark.createDataFrame(some, fields)
    both = [
        {r.id: r.override and r.override.trade for r in expand.with_override(objects, overrides, "room", n).collect()} for n in (50, 1)
    ]
    assert both[0] == both[1] == {1: "T1", 2: "T2", 3: None, 4: None}


def test_rules_with_many_keywords_stay_in_order(spark):
    schema = "id long, active boolean, ruleset_version string, keywords string, trade string, unit string, rate double, material string"
    rules = spark.createDataFrame([(1, True, "v", ",".join(f"k{i}" for i in range(1500)), "A", "nos", 1.0, "m"), (2, True, "v", "z", "B", "nos", 1.0, "m")], schema)
    words = [r.key for r in keyword_overrides(rules, "v").orderBy("priority").collect()]
    assert words[-1] == "z" and words[1499] == "k1499"


def test_only_failed_calls_get_the_template(spark):
    drawings = spark.createDataFrame([(1, 1, True), (1, 2, False)], "project_id long, drawing_id long, failed boolean")
    none = drawings.select("project_id", "drawing_id", F.lit(0).alias("pos"), F.get(ingest.fallback_array(), F.lit(0)).alias("o")).limit(0)
    got = ingest.with_fallback(drawings, none).groupBy("drawing_id", "origin").count().collect()
    assert [tuple(r) for r in got] == [(1, "template", 20)]


def test_wastage_and_vendors_do_not_multiply_lines(spark):
    lines = spark.createDataFrame([("m", 10.0)], "material_name string, quantity double")
    wastage = spark.createDataFrame([("m", 5.0), ("m", 10.0)], "material_name string, wastage_pct double")
    assert [r.quantity_with_wastage for r in materials.with_wastage(lines, wastage).collect()] == [11.0]


def test_expanded_lines_go_through_numbering_and_the_sheet(spark):
    projects = spark.createDataFrame([(1, "P", None)], "id long, name string, client string")
    drawings = spark.createDataFrame([(1, 10, True)], "project_id long, drawing_id long, failed boolean")
    none = drawings.select("project_id", "drawing_id", F.lit(0).alias("pos"), F.get(ingest.fallback_array(), F.lit(0)).alias("o")).limit(0)
    objects = ingest.normalised(ingest.with_fallback(drawings, none), 0.7, "rule").withColumn("id", F.col("pos").cast("long"))
    lines = expand.expand_with(objects, RuleSet())
    assert lines.select("id").distinct().count() == lines.count() == 20
    assert {r.id for r in lines.collect()} == {r.id for r in expand.expand_with(objects.repartition(3), RuleSet()).collect()}
    assert boq.line_numbers(lines, block_width=1 << 60).count() == 20
    from datetime import UTC, datetime

    sheet = export.bill_sheet(lines, projects, datetime(2024, 6, 1, tzinfo=UTC), block_width=1 << 60)
    assert sheet.filter(F.col("text").endswith("Grand Total,427150")).count() == 1


def test_an_upload_in_several_batches_keeps_all_its_lines(spark):
    from tallyspark.streaming import live

    schema = "project_id long, drawing_id long, id long, upload_id long"
    batches = [[(1, 1, 10, 1), (1, 2, 20, 1)], [(1, 1, 11, 1)], [(1, 2, 21, 2), (1, 2, 22, 1)]]
    handle, path = live.expand_batches(spark, lambda b: b, "several")
    for i, rows in enumerate(batches):
        handle(spark.createDataFrame(rows, schema), i)
    kept = live.current_lines(spark, path, spark.createDataFrame([], "project_id long, drawing_id long, id long").schema)
    assert sorted(r.id for r in kept.collect()) == [10, 11, 21]
