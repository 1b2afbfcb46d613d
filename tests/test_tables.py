"""Materials, table upkeep, sources and quality checks on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evaluate, ingest, maintenance, materials, quality
from tallyspark.rules import active_rules, keyword_overrides
from tallyspark.operators.expand import with_override
from tallyspark.session import shared_root
from tallyspark.sources import cad, detections, files, fixtures, tables

MATERIALS = (
    (1, "Saint Gobain Glass 10mm", "Saint Gobain", "Glass", 320.0, 18.0, True),
    (2, "Modiguard Toughened Glass 10mm", "Modiguard", "Glass", 280.0, 18.0, False),
    (3, "AIS Glass 10mm", "AIS", "Glass", 360.0, 18.0, False),
    (4, "Vitrified Tile 600x600mm", "Nitco", "Tile", 250.0, 18.0, True),
    (5, "Gypsum Board 12.5mm", "Saint Gobain", "Wall", 110.0, 18.0, True),
    (6, "Workstation 1200x750mm", "Spaces", "Furniture", 23000.0, 18.0, True),
)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = spark.createDataFrame(
        MATERIALS, "id long, name string, brand string, category string, rate double, gst_rate double, is_preferred boolean"
    )
    return rows.withColumn("active", F.col("id") != 3)


def test_alternatives(catalogue, spark):
    asked = spark.createDataFrame([(1,), (4,)], "material_id long")
    got = sorted((r["material_id"], r["alternative_id"]) for r in materials.alternatives(asked, catalogue).collect())
    assert got == [(1, 2), (1, 3)]
    report = {r["material_id"]: (r["alternatives"], r["cheapest_id"], r["saving"]) for r in materials.alternative_report(catalogue).collect()}
    assert report == {1: (2, 2, 40.0), 2: (2, 1, -40.0), 3: (2, 2, 80.0), 4: (0, None, None), 5: (0, None, None), 6: (0, None, None)}


def brute_candidates(trade, name, k):
    hits = [
        m[0]
        for m in MATERIALS
        if m[0] != 3 and (m[3].lower().startswith((trade or "").lower()) or m[1].lower().startswith((name or "").lower()))
    ]
    return hits[:k]


@pytest.mark.parametrize("k", [1, 2, 20])
def test_candidates_equal_brute_force(catalogue, spark, k):
    lines = [(1, "Glass", "Zinc"), (2, "gla", "vitri"), (3, None, "x"), (4, "x", None), (5, "Wall", "work"), (6, "q", "q")]
    table = spark.createDataFrame(lines, "id long, trade string, material_name string")
    got = {}
    for r in materials.candidates_for_lines(table, catalogue, k).orderBy("rank").collect():
        got.setdefault(r["boq_item_id"], []).append(r["material_id"])
    assert got == {i: brute_candidates(t, n, k) for i, t, n in lines if brute_candidates(t, n, k)}


def test_candidates_by_word(catalogue, spark):
    patterns = spark.createDataFrame([("Glass", "Gypsum plain"), ("x", "10mm board"), ("x", "")], "trade string, material_name string")
    got = {(r["trade"], r["material_name"], r["material_id"]) for r in materials.candidates_by_word(patterns, catalogue).collect()}
    assert got == {
        ("Glass", "Gypsum plain", 1), ("Glass", "Gypsum plain", 2), ("Glass", "Gypsum plain", 3), ("Glass", "Gypsum plain", 5),
        ("x", "10mm board", 1), ("x", "10mm board", 2), ("x", "10mm board", 3),
    }


def test_choice_keeps_the_quantity(catalogue, spark):
    lines = spark.createDataFrame(
        [(1, 1, 40.0, 650.0, 26000.0, None, "old"), (2, 1, 1.0, 10.0, 10.0, None, "old")],
        "id long, project_id long, quantity double, rate double, total double, material_id long, material_name string",
    )
    choices = spark.createDataFrame([(1, 2)], "boq_item_id long, material_id long")
    one, two = materials.choose_materials(lines, choices, catalogue).orderBy("id").collect()
    assert (one["material_name"], one["rate"], one["total"]) == ("Modiguard Modiguard Toughened Glass 10mm", 280.0, 11200.0)
    assert one["total_with_tax"] == pytest.approx(13216.0)
    assert (two["material_name"], two["total"], two["material_id"]) == ("old", 10.0, None)


def test_search(catalogue):
    found = materials.search(catalogue, q="GLASS", category="Glass", limit=2).collect()
    assert [r["id"] for r in found] == [3, 2]
    assert materials.matching_any(catalogue, "saint").count() == 2
    assert materials.matching_any(catalogue, "").count() == 6


def test_user_rules(spark):
    rows = [
        (1, "b", "room", "Civil", None, "sft", 85.0, "Brick", None, True, "v1"),
        (2, "a", "room", "Stone", None, "sft", 95.0, "Stone", "Lobby, hall", True, "v1"),
        (3, "c", "door", "Wood", None, "nos", 10.0, "Door", "hall", True, "v1"),
        (4, "d", "door", "Wood", None, "nos", 11.0, "Door", None, False, "v1"),
        (5, "e", "lift", "Lift", None, None, None, None, None, True, "v2"),
    ]
    table = spark.createDataFrame(
        rows,
        "id long, key string, object_type string, trade string, category string, unit string, rate double,"
        " material string, keywords string, active boolean, ruleset_version string",
    )
    rules = {r["object_type"]: (r["trade"], r["rate"], r["per_area"]) for r in active_rules(table, "v1").collect()}
    assert rules == {"room": ("Stone", 95.0, 1), "door": ("Wood", 10.0, 0)}
    words = keyword_overrides(table, "v1")
    assert sorted(r["key"] for r in words.collect()) == ["hall", "hall", "lobby"]
    objects = spark.createDataFrame(
        [(1, 1, "room", "Main HALL"), (2, 1, "room", "Attic"), (3, 1, "door", "hall"), (4, 1, "room", None)],
        "id long, drawing_id long, object_type string, label string",
    )
    for inline in (50, 0):
        chosen = with_override(objects, words, "room", max_inline=inline)
        assert {r["id"]: r["override"] and r["override"]["trade"] for r in chosen.collect()} == {
            1: "Stone", 2: None, 3: None, 4: None,
        }


def test_bucketed_replacement_drops_empty_projects(spark, tmp_path):
    path = str(tmp_path / "bill")
    old = spark.range(400).select(F.col("id"), (F.col("id") % 20).alias("project_id"), F.lit(1.0).alias("total"))
    maintenance.write_bucketed(old, path, 8)
    scope = spark.createDataFrame([(p,) for p in range(0, 20, 2)], "project_id long")
    new = old.where("project_id = 4").withColumn("total", F.lit(2.0))
    maintenance.replace_bucketed(path, new, scope, ["project_id"], 8)
    got = maintenance.read_bucketed(spark, path, old.schema).groupBy("project_id").agg(F.sum("total").alias("t"))
    assert {r["project_id"]: r["t"] for r in got.collect()} == {**{p: 20.0 for p in range(1, 20, 2)}, 4: 40.0}
    everything = spark.createDataFrame([(p,) for p in range(20)], "project_id long")
    maintenance.replace_bucketed(path, new.limit(0), everything, ["project_id"], 8)
    assert maintenance.read_bucketed(spark, path, old.schema).count() == 0


def test_edits(spark):
    lines = spark.createDataFrame([(1, 2.0, 10.0, 20.0), (2, 3.0, 5.0, 15.0)], "id long, quantity double, rate double, total double")
    edits = spark.createDataFrame(
        [(1, 1, "quantity", "4.5 sft", 1), (2, 1, "quantity", "oops", 2), (3, 1, "rate", "-7", 3), (4, 1, "total", "9", 4), (5, 2, "rate", "1.115", 1)],
        "edit_id long, id long, field string, raw string, ts long",
    )
    patches = maintenance.edit_patches(lines, edits)
    got = maintenance.updated(lines, patches, "id", ["quantity", "rate", "total"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 4.5, 10.0, 45.0), (2, 3.0, 1.115, 3.35)]


def test_lookup_and_cascade(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    table = spark.createDataFrame([(1,), (3,), (3,)], "k long")
    assert {r["k"]: r["state"] for r in maintenance.lookup(keys, table, "k").collect()} == {1: "ok", 2: "missing", 3: "duplicate"}
    projects = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 2)], "id long, project_id long")
    left = maintenance.delete_projects(keys.where("k = 1").withColumnRenamed("k", "project_id"), projects, {"c": child})
    assert [r["id"] for r in left["projects"].collect()] == [2] and [r["id"] for r in left["c"].collect()] == [11]
    linked = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id long, ref long")
    got = maintenance.unlink_missing(linked, child, "ref").orderBy("id").collect()
    assert [r["ref"] for r in got] == [10, None, None]


def test_responses(spark):
    body = '[{"object_type":"door","confidence":1.5},{"bbox":{"x":1,"w":3,"height":4},"confidence":"0.9"}]'
    texts = [
        f"Sure:\n```json\n{body}\n```\nsee [1]", f'{{"objects": {body}}}', f"{body} and [2]", '{"object_type":"x"}',
        "```\n[]\n```", "[null]", "no plan", "[{'object_type':'q'}]", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "drawing_id long, response string")
    found = detections.explode_detections(rows)
    counts = {r["drawing_id"]: r["count"] for r in found.groupBy("drawing_id").count().collect()}
    assert counts == {0: 2, 1: 2}
    first = ingest.normalised(found.where("drawing_id = 0")).orderBy("pos").collect()
    assert (first[0]["object_type"], first[0]["confidence"], first[0]["bbox"]) == ("door", 1.0, None)
    assert (first[1]["object_type"], first[1]["confidence"]) == ("unknown", None)
    assert first[1]["bbox"].asDict() == {"x": 1.0, "y": None, "width": 3.0, "height": 4.0}
    assert detections.explode_detections(rows, first=1).count() == 2


def dxf(entities):
    """Text of a CAD file with a header, a door block and the given entities."""
    pairs = [(0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, 4), (0, "ENDSEC"), (0, "SECTION"), (2, "BLOCKS"),
             (0, "BLOCK"), (8, "0"), (0, "ARC"), (8, "A-DOOR"), (40, 900), (0, "LINE"), (8, "A-DOOR"), (0, "ENDBLK"), (8, "0"),
             (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")]
    for kind, layer, extra in entities:
        pairs += [(0, kind), (8, layer), *extra]
    pairs += [(0, "ENDSEC"), (0, "EOF")]
    return "".join(f"{code:>3}\n{value}\n" for code, value in pairs)


def test_cad_file(spark, tmp_path):
    rows = [("LINE", "A-WALL", [(10, i), (20, 0), (11, 8534), (21, 9144)]) for i in range(6)]
    rows += [("LINE", "A-GLAZ", [(10, 5486), (20, 500 + i)]) for i in range(26)]
    rows += [("INSERT", "A-DOOR", [(2, "DOOR-900")])] + [("LINE", "A-DOOR", [])] * 4 + [("ARC", "A-DOOR", [(40, 900)])] * 2
    labels = ["Room 1 - Office", "Room 2", "Room 3", "10'-0\" x 12'-0\"", "8'-0\" x 10'-0\"", "6'-0\" x 8'-0\"", "28'-0\"", "30'-0\""]
    rows += [("TEXT", "A-ANNO-TEXT", [(1, label)]) for label in labels]
    (tmp_path / "plan.dxf").write_text(dxf(rows))
    (tmp_path / "empty.dxf").write_text("")
    # splits of 256 bytes: one file is read by several tasks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = cad.read_lines(spark, str(tmp_path / "*.dxf"))
        assert lines.rdd.getNumPartitions() >= 1
        text = (tmp_path / "plan.dxf").read_text().splitlines()
        assert [r["line"] for r in lines.orderBy("line_no").collect()] == text
        for width in (3, 1_000_000):
            found = cad.drawn(cad.entities(lines, block_width=width))
            counts = {(r["layer"], r["entity"]): r["entities"] for r in cad.layer_counts(found).collect()}
            assert counts == {
                ("A-WALL", "LINE"): 6, ("A-GLAZ", "LINE"): 26, ("A-DOOR", "LINE"): 5, ("A-DOOR", "ARC"): 3,
                ("A-DOOR", "INSERT"): 1, ("A-ANNO-TEXT", "TEXT"): 8,
            }
        box = cad.extents(found).first()
        assert (box["min_x"], box["max_x"], box["max_y"]) == (0.0, 8534.0, 9144.0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "c.png").write_bytes(b"not a picture")
    (tmp_path / "d.exe").write_bytes(b"MZ")
    found = files.manifest(files.read_files(spark, str(tmp_path)))
    assert {r["name"]: r["length"] for r in found.collect()} == {"a.pdf": 12, "b.pdf": 12, "c.png": 13, "d.exe": 2}
    unique = files.first_of_each_content(found)
    assert sorted(r["copies"] for r in unique.collect()) == [1, 1, 2]
    assert files.not_yet_processed(found, unique.where("copies = 2")).count() == 2
    problems = {(r["key"].rsplit("/", 1)[1], r["rule"]) for r in quality.upload_problems(found).collect()}
    assert problems == {("c.png", "content does not fit type"), ("d.exe", "type not allowed")}


def test_null_totals_differ_from_absent_ones(spark):
    texts = [
        '{"trades":[{"trade":"Civil","computed_total":null,"expected_total":100},{"trade":"Paint","expected_total":7}]}',
        '{"trades":[{"trade":"Civil","computed_total":0,"expected_total":100}]}', '{"trades":[]}', "no json", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "project_id long, text string").withColumn("truth", fixtures.parse_truth(F.col("text")))
    got = {r["project_id"]: r["total"] for r in evaluate.truth_totals(fixtures.truth_trades(docs)).collect()}
    assert got == {0: 7.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_nested_fixtures(spark, tmp_path):
    path = tmp_path / "expected.json"
    path.write_text(json.dumps({"clinic": {"rooms": 4, "area": 346}, "office": {"rooms": 5, "area": 450}}, indent=1))
    got = fixtures.named_fixtures(spark, str(path), ["clinic", "office"], "rooms:long,area:long")
    assert {r["fixture"]: (r["rooms"], r["area"]) for r in got.collect()} == {"clinic": (4, 346), "office": (5, 450)}


def test_budget_verdicts(spark):
    rows = [("a", 3_000_000.0, 346.0), ("b", 1_000_000.0, 346.0), ("c", 100.0, 346.0)]
    table = spark.createDataFrame(rows, "fixture string, estimate double, area double").withColumns(
        {"low_budget": F.lit(2_500_000.0), "high_budget": F.lit(5_000_000.0)}
    )
    got = {r["fixture"]: (r["verdict"], r["scaled_estimate"], r["scaled_low"]) for r in evaluate.budget_verdicts(table).collect()}
    # 6 251 940 * 346 / 1900 = 1 138 511.18
    assert got == {
        "a": ("in range", 1138511, 455404), "b": ("in scaled range", 1138511, 455404), "c": ("out of range", 1138511, 455404),
    }


def test_verdicts_and_sets(spark):
    rows = [("p", True, True, 0), ("v", True, False, 0), ("e", False, False, 1), ("s", False, True, 0), ("o", False, False, 0)]
    table = spark.createDataFrame(rows, "run string, passed boolean, skipped boolean, errors int")
    assert {r["run"]: r["verdict"] for r in evaluate.scenario_rollup(table, "run").collect()} == {
        "p": "partial", "v": "validated", "e": "error", "s": "structural failure", "o": "overfit",
    }
    left, right = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in ("aab", "bc"))
    assert {tuple(r) for r in evaluate.reconcile(left, right, ["x"]).collect()} == {("a", "missing"), ("c", "unexpected")}


def test_stored_tables(spark, tmp_path):
    for name in tables.TABLES:
        tables.append_rows(spark.createDataFrame([(1,)], "id long"), str(tmp_path), name)
        assert tables.read_table(spark, str(tmp_path), name).count() == 1
    lines = spark.createDataFrame([(2, 7, "a", 2.5, 10.125)], "id long, project_id long, description string, quantity double, total double")
    tables.append_rows(lines, str(tmp_path), "boq_items")
    row = tables.read_table(spark, str(tmp_path), "boq_items", ["id", "quantity", "total"]).where("id = 2").first()
    assert (float(row["quantity"]), float(row["total"])) == (2.5, 10.13)
    with pytest.raises(ValueError, match="no columns"):
        tables.append_rows(lines.withColumn("odd", F.lit(1)), str(tmp_path), "boq_items")


def test_state_violations(spark):
    projects = spark.createDataFrame([(1, "draft"), (2, "lost")], "id long, status string")
    drawings = spark.createDataFrame([(1, "error"), (2, None), (3, "sent")], "id long, status string")
    objects = spark.createDataFrame([(1, "ai", 0.5), (2, "x", 1.5), (3, None, None)], "id long, detection_source string, confidence double")
    got = {tuple(r) for r in quality.state_violations(projects, drawings, objects).collect()}
    assert got == {("2", "project status"), ("3", "drawing status"), ("2", "detection source"), ("2", "confidence")}


class _Session:
    """The parts of a session that name the shared folder."""

    def __init__(self, named, master):
        self.conf = self
        self.sparkContext = self
        self.named, self.master = named, master

    def get(self, key, default):
        return self.named if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_shared_root_comes_from_the_session(spark):
    assert shared_root(spark)
    assert shared_root(_Session("hdfs:///shared", "spark://m")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(_Session(None, "spark://m"))
