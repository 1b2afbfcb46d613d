"""Known bills: the fallback template, detections of one plan, and the reference bill."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from golden_bill import BILL
from tallyspark.operators import boq, costing, derive, diagnostics, evaluate, export, ingest
from tallyspark.operators.expand import expand_with, objects_without_rule
from tallyspark.rules import RuleSet

RULES = RuleSet()


def by_trade(lines):
    return {r["trade"]: (r["total"], r["count"]) for r in boq.trade_summary(lines).collect()}


@pytest.fixture(scope="module")
def template(spark):
    drawings = spark.createDataFrame([(1, 10, True)], "project_id long, drawing_id long, failed boolean")
    none = drawings.select("project_id", "drawing_id", F.lit(0).alias("pos"), F.get(ingest.fallback_array(), F.lit(0)).alias("o")).limit(0)
    rows = ingest.normalised(ingest.with_fallback(drawings, none), 0.7, "rule")
    return rows.withColumn("id", F.col("pos").cast("long"))


def test_template_bill(template):
    assert by_trade(expand_with(template, RULES)) == {
        "Modular Furniture": (324000.0, 6),
        "Carpentry": (71000.0, 4),
        "Civil": (21160.0, 4),
        "Electrical": (6750.0, 3),
        "Gypsum": (4240.0, 3),
    }


def test_template_costs(template):
    totals = boq.project_totals(boq.trade_summary(expand_with(template, RULES)))
    figures = costing.cost_rollup(totals).first()
    assert (figures["materials_total"], figures["subtotal"], figures["total"]) == (427150.0, 632182.0, 758618.4)


def test_template_findings(template, spark):
    summary = boq.trade_summary(expand_with(template, RULES))
    found = diagnostics.trade_outliers(summary).collect()
    assert [(r["trade"], r["expected"], r["severity"], r["line"]) for r in found] == [
        ("Modular Furniture", 85430, "med", "6 items, ₹3,24,000")
    ]
    savings = diagnostics.value_engineering(summary).orderBy("rank").collect()
    assert [r["saving"] for r in savings] == [16200, 3550, 1058] and savings[0]["total_saving"] == 20808
    projects = spark.createDataFrame([(1,), (2,)], "id long")
    missing = diagnostics.missing_trades(projects, summary).collect()
    assert sorted(r["trade"] for r in missing if r["project_id"] == 1) == ["HVAC", "Painting", "Plumbing"]
    assert sum(r["project_id"] == 2 for r in missing) == 8


def test_template_extents(template):
    bare = template.select(
        "id", "drawing_id", "object_type", "label", "bbox", "confidence", "trade", "detection_source",
        *[F.lit(None).cast("double").alias(c) for c in ("bbox_x", "bbox_y", "length_mm", "width_mm", "area_mm2")],
    )
    box = ingest.fit_to_view(ingest.to_millimetres(ingest.plan_objects(bare)), 800.0, 600.0).first()
    assert [round(box[c], 6) for c in ("min_x", "max_x", "min_y", "max_y")] == [0.0, 18000.0, 0.0, 8000.0]


def test_detected_plan(spark):
    kinds = {"partition": 9, "wall": 1, "furniture": 14, "door": 6, "window": 8, "electrical": 24, "column": 4, "ceiling": 2}
    rows = [(i, 1, 1, kind, None, None) for i, kind in enumerate(k for k, n in kinds.items() for _ in range(n))]
    objects = spark.createDataFrame(
        rows, "id long, project_id long, drawing_id long, object_type string, label string, quantity_estimate double"
    )
    assert by_trade(expand_with(objects, RULES)) == {
        "Modular Furniture": (322000.0, 14),
        "Carpentry": (230000.0, 14),
        "Electrical": (54000.0, 24),
        "Civil": (26085.0, 5),
        "Gypsum": (2120.0, 11),
    }


def test_room_labels_choose_rules(spark):
    labels = ["Reception/Waiting Area", "Cabin-1", "SERVER room cabin", "Meeting Room", None, "Gents Toilet"]
    rows = [(i, 1, 1, "room", label, 12.5) for i, label in enumerate(labels)] + [(9, 1, 1, "sofa", "cabin", 1.0)]
    objects = spark.createDataFrame(
        rows, "id long, project_id long, drawing_id long, object_type string, label string, quantity_estimate double"
    )
    got = expand_with(objects, RULES).orderBy("detected_object_id").collect()
    assert [(r["material_name"], r["quantity"], r["total"]) for r in got] == [
        ("Reception counter + waiting area", 1, 85000.0),
        ("Cabin partition + furniture", 1, 85000.0),
        ("Cabin partition + furniture", 1, 85000.0),
        ("Brick masonry", 13, 1105.0),
        ("Brick masonry", 13, 1105.0),
        ("Gents toilet fixtures + tiling", 1, 85000.0),
    ]
    assert got[4]["description"] == "room — Brick masonry"
    left = objects_without_rule(objects, RULES.rules_table(spark)).collect()
    assert [r["object_type"] for r in left] == ["sofa"]


@pytest.fixture(scope="module")
def bill(spark):
    rows, n = [], 0
    for trade, lines in BILL:
        for quantity, unit, rate in lines:
            n += 1
            rows.append((n, 1, f"line {n}", trade, float(quantity), unit, float(rate)))
    raw = spark.createDataFrame(
        rows, "id long, project_id long, description string, trade string, quantity double, unit string, rate double"
    )
    return raw.withColumn("total", boq.lump_sum_total(F.col("quantity"), F.col("unit"), F.col("rate")))


def test_reference_bill(bill):
    totals = boq.project_totals(boq.trade_summary(bill)).first()
    assert (totals["lines"], totals["trades"], totals["total"]) == (104, 13, 6211090.0)
    gate = evaluate.tolerance_gate(
        boq.project_totals(boq.trade_summary(bill)).select(F.col("total").alias("actual"), F.lit(6251940.0).alias("expected"))
    ).first()
    assert gate["passed"] and gate["delta_pct"] == pytest.approx(0.653, abs=5e-4)


def test_reference_costs(bill):
    figures = costing.cost_rollup(boq.project_totals(boq.trade_summary(bill))).first().asDict()
    assert figures == {
        "project_id": 1,
        "materials_total": 6211090.0,
        "labour_total": 2173881.5,
        "transport_total": 310554.5,
        "overheads_total": 496887.2,
        "subtotal": 9192413.2,
        "markup_amount": 1378861.98,
        "contingency_amount": 459620.66,
        "total": 11030895.84,
    }


def test_reference_findings(bill):
    summary = boq.trade_summary(bill)
    assert diagnostics.trade_outliers(summary).count() == 0
    large = {r["trade"]: (r["got"], r["severity"]) for r in diagnostics.absolute_outliers(summary).collect()}
    assert large == {
        "Civil Work & Plumbing Work": (1061700, "med"),
        "VRF HVAC Works": (918000, "med"),
        "POP/Gypsum Work": (807910, "med"),
        "Electrical & Lighting Work & IT Work": (804130, "med"),
    }
    savings = diagnostics.value_engineering(summary).orderBy("rank").collect()
    assert [r["saving"] for r in savings] == [53085, 45900, 40396] and savings[0]["total_saving"] == 139381


def test_sections_and_context(bill):
    rows = {r["section"]: r["total"] for r in boq.sections(bill).collect()}
    assert len(rows) == 14 and rows["Grand Total"] == 6211090.0 and rows["Plumbing Work"] == 39100.0
    context = diagnostics.bill_context(boq.trade_summary(bill, first_seen="id")).first()
    assert context["context"].split("\n")[0] == "Civil Work & Plumbing Work: ₹10,61,700 (11 items)"
    assert context["citations"][4] == "Painting & Cleaning Work total ₹2,04,900" and len(context["citations"]) == 5


def test_snapshot_and_history(bill, spark):
    at = datetime(2026, 7, 22, 9, 5, tzinfo=UTC)
    row = costing.cost_snapshot(boq.trade_summary(bill), at).first()
    assert row["version_label"] == "v1784711100000" and row["ruleset_version"] == "office_india_v1"
    assert row["breakdown"].startswith('[{"trade":"Civil Work & Plumbing Work","total":1061700.0,"count":11}')
    versions = spark.createDataFrame(
        [(1, 1, "a", 10.0, at), (2, 1, "b", 12.5, at), (3, 2, "c", 1.0, at)],
        "id long, project_id long, version_label string, total double, created_at timestamp",
    )
    history = {r["id"]: (r["position"], r["active"]) for r in costing.version_history(versions).collect()}
    assert history == {1: (2, False), 2: (1, True), 3: (1, True)}
    changes = {r["id"]: r["change"] for r in costing.version_changes(versions).collect()}
    assert changes == {1: None, 2: 2.5, 3: None}


def test_sheets(bill, spark, tmp_path):
    lines = bill.withColumn("description", F.concat("description", F.lit(', 10" wide')))
    projects = spark.createDataFrame([(1, "Office, Pune", None), (2, "Empty", "X")], "id long, name string, client string")
    at = datetime(2026, 7, 22, 9, 5, tzinfo=UTC)
    sheet = export.bill_sheet(lines, projects, at, block_width=10)
    rows = sheet.where("project_id = 1").orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == list(range(110))
    assert [r["text"] for r in rows[:5]] == [
        "Bill of Quantities", 'Project,"Office, Pune"', "Client,", "Generated,2026-07-22T09:05:00.000Z",
        "Trade,Description,Quantity,Unit,Rate,Amount",
    ]
    assert rows[5]["text"] == 'Addressable Fire Alarm System,"line 102, 10"" wide",1800,sqft,140,252000'
    assert rows[-1]["text"] == ",,,,Grand Total,6211090"
    assert [r["text"] for r in sheet.where("project_id = 2").orderBy("line_no").collect()][-1] == ",,,,Grand Total,0"
    plain = export.bill_sheet(lines, projects, at, legacy=True).where("line_no = 5 AND project_id = 1").first()
    assert plain["text"] == 'Addressable Fire Alarm System,line 102, 10" wide,1800,sqft,140,252000'

    export.write_text_sheets(sheet, str(tmp_path / "text"))
    files = sorted((tmp_path / "text" / "project_id=1").glob("part-*"))
    text = [line for f in files for line in f.read_text().splitlines()]
    assert text == [r["text"] for r in rows]
    back = export.read_text_sheets(spark, str(tmp_path / "text"))
    assert back.count() == 104 and back.agg(F.sum("amount")).first()[0] == 6211090.0
    assert back.where(F.col("description") == 'line 102, 10" wide').count() == 1


def test_portfolio(spark):
    rows = [("in_progress", 1), ("draft", 0), ("priced", 2), ("sent", 0)]
    projects = spark.createDataFrame(rows, "status string, drawings_count int")
    assert derive.portfolio(projects).first().asDict() == {"total": 4, "in_progress": 2, "sent": 1, "with_drawings": 2}
