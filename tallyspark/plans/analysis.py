"""Queries of joins, aggregations, windows, orders and set operations."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tallyspark.functions import numbers as N
from tallyspark.functions.text import CATEGORY_ATTRIBUTES
from tallyspark.operators import (
    boq,
    costing,
    derive,
    diagnostics,
    evaluate,
    expand,
    export,
    ingest,
    maintenance,
    materials,
    quality,
)
from tallyspark.plans.bindings import (
    BOUND_RULES,
    WASTAGE,
    Tables,
    half_up_sql,
    money_sql,
    sum_money_sql,
    sum_quantity_sql,
)
from tallyspark.plans.estimate import estimate, overview
from tallyspark.plans.reading import _HEIGHTS_SQL, _ROLL_SQL, _CATEGORY_SQL, _kinds
from tallyspark.plans.registry import indian_sql, query, stamp, stamp_sql
from tallyspark.rules import TYPICAL_TRADES, literal_table
from tallyspark.sources import cad, detections, files, fixtures
from tallyspark.streaming import deadlines

# ------------------------------------------------------------------ joins


@query(
    "j01_objects_with_rule",
    """SELECT drawing_id, object_type, trade, unit, rate, material, CAST(per_area AS BIGINT) AS per_area
    FROM objects JOIN rules USING (object_type)""",
    ("objects", "rules"),
)
def _(t: Tables):
    rules = BOUND_RULES.rules_table(t.spark)
    return t.objects.select("drawing_id", "object_type").join(rules, "object_type").withColumn(
        "per_area", F.col("per_area").cast("long")
    )


@query(
    "j01b_objects_without_rule",
    "SELECT drawing_id, object_type, label FROM objects WHERE object_type NOT IN (SELECT object_type FROM rules)",
    ("objects", "rules"),
)
def _(t: Tables):
    return expand.objects_without_rule(t.objects, BOUND_RULES.rules_table(t.spark)).select(
        "drawing_id", "object_type", "label"
    )


@query(
    "j02_label_overrides",
    """SELECT drawing_id, label, (SELECT arg_min(key, priority) FROM overrides WHERE contains(lower(label), key)) AS key
    FROM objects WHERE object_type = 'STANDARD'""",
    ("objects", "overrides"),
)
def _(t: Tables):
    rooms = t.objects.where(F.col("object_type") == BOUND_RULES.override_type)
    chosen = expand.with_override(rooms, BOUND_RULES.overrides_table(t.spark), BOUND_RULES.override_type)
    return chosen.select("drawing_id", "label", "override.key")


@query(
    "j02_label_overrides_many",
    """SELECT drawing_id, label, (SELECT arg_min(key, priority) FROM overrides WHERE contains(lower(label), key)) AS key
    FROM objects WHERE object_type = 'STANDARD'""",
    ("objects", "overrides"),
)
def _(t: Tables):
    rooms = t.objects.where(F.col("object_type") == BOUND_RULES.override_type)
    chosen = expand.with_override(
        rooms, BOUND_RULES.overrides_table(t.spark), BOUND_RULES.override_type, max_inline=1
    )
    return chosen.select("drawing_id", "label", "override.key")


@query(
    "j03_material_candidates",
    """WITH patterns AS (SELECT DISTINCT coalesce(trade, '') AS trade, coalesce(material_name, '') AS material_name FROM bill
      UNION SELECT DISTINCT trade, split_part(lower(label), ' ', 1) FROM lines),
    ranked AS (SELECT p.trade, p.material_name, m.id AS material_id,
      row_number() OVER (PARTITION BY p.trade, p.material_name ORDER BY m.id) AS rank
      FROM patterns p JOIN materials m ON m.active AND (starts_with(lower(category), lower(p.trade)) OR starts_with(lower(name), lower(p.material_name))))
    SELECT trade, material_name, material_id, rank FROM ranked WHERE rank <= 20""",
    ("bill", "lines", "materials"),
)
def _(t: Tables):
    named = t.lines.select("trade", F.get(F.split(F.lower("description"), " "), F.lit(0)).alias("material_name"))
    patterns = materials.line_patterns(t.bill).unionByName(materials.line_patterns(named)).distinct()
    return materials.candidates_by_pattern(patterns, t.materials)


@query(
    "j03_line_candidates",
    """WITH patterns AS (SELECT DISTINCT coalesce(trade, '') AS trade, coalesce(material_name, '') AS material_name FROM bill),
    ranked AS (SELECT p.trade, p.material_name, m.id AS material_id,
      row_number() OVER (PARTITION BY p.trade, p.material_name ORDER BY m.id) AS rank
      FROM patterns p JOIN materials m ON m.active AND (starts_with(lower(category), lower(p.trade)) OR starts_with(lower(name), lower(p.material_name))))
    SELECT b.id AS boq_item_id, CAST(count(*) AS BIGINT) AS candidates, CAST(min(material_id) AS BIGINT) AS first_id,
      CAST(sum(material_id) AS BIGINT) AS id_sum
    FROM bill b JOIN ranked r ON r.trade = coalesce(b.trade, '') AND r.material_name = coalesce(b.material_name, '')
    WHERE rank <= 20 GROUP BY 1""",
    ("bill", "materials"),
)
def _(t: Tables):
    found = materials.candidates_for_lines(t.bill, t.materials)
    return found.groupBy("boq_item_id").agg(
        F.count("*").alias("candidates"), F.min("material_id").alias("first_id"), F.sum("material_id").alias("id_sum")
    )


@query(
    "j04_candidates_by_word",
    """WITH patterns AS (SELECT DISTINCT coalesce(trade, '') AS trade, coalesce(material_name, '') AS material_name FROM bill)
    SELECT p.trade, p.material_name, m.id AS material_id FROM patterns p JOIN materials m
    ON m.category = p.trade OR (p.material_name <> '' AND contains(lower(m.name), split_part(lower(p.material_name), ' ', 1)))""",
    ("bill", "materials"),
)
def _(t: Tables):
    return materials.candidates_by_word(materials.line_patterns(t.bill), t.materials)


@query(
    "j05_choose_material",
    f"""SELECT b.id, m.id AS material_id, CASE WHEN m.id IS NULL THEN b.material_name ELSE trim(m.brand || ' ' || m.name) END AS material_name,
    coalesce(m.rate, b.rate) AS rate, CASE WHEN m.id IS NULL THEN b.total ELSE {money_sql('b.quantity * m.rate')} END AS total,
    CASE WHEN m.id IS NULL THEN b.total ELSE {money_sql('b.quantity * m.rate')} * (1.0 + m.gst_rate / 100.0) END AS total_with_tax
    FROM bill b LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS pk FROM lineitem GROUP BY 1) c ON c.l_orderkey = b.id
    LEFT JOIN materials m ON m.id = c.pk""",
    ("bill", "materials"),
)
def _(t: Tables):
    choices = (
        t.raw("lineitem")
        .groupBy(F.col("l_orderkey").alias("boq_item_id"))
        .agg(F.max("l_partkey").alias("material_id"))
    )
    return materials.choose_materials(t.bill, choices, t.materials).select(
        "id", "material_id", "material_name", "rate", "total", "total_with_tax"
    )


@query(
    "j06_alternatives",
    f"""SELECT a.id AS material_id, CAST(n - 1 AS BIGINT) AS alternatives,
      CASE WHEN a.id = ids[1] THEN ids[2] ELSE ids[1] END AS cheapest_id,
      CASE WHEN a.id = ids[1] THEN rates[2] ELSE rates[1] END AS cheapest_rate,
      {money_sql('a.rate - CASE WHEN a.id = ids[1] THEN rates[2] ELSE rates[1] END')} AS saving
    FROM materials a JOIN (SELECT category, count(*) AS n, list(id ORDER BY rate, id) AS ids, list(rate ORDER BY rate, id) AS rates
      FROM materials GROUP BY 1) c ON c.category = a.category""",
    ("materials",),
)
def _(t: Tables):
    return materials.alternative_report(t.materials)


_TYPICAL_SQL = "(VALUES " + ", ".join(f"('{name}')" for name in TYPICAL_TRADES) + ") AS v(trade)"


@query(
    "j07_missing_trades",
    f"""SELECT p.id AS project_id, v.trade, 'No items detected in ' || v.trade || '. Typical interior fit-out includes this trade.' AS reason,
    CAST(1 AS BIGINT) AS suggested_qty, 'lot' AS unit FROM projects p CROSS JOIN {_TYPICAL_SQL}
    WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.project_id = p.id AND l.trade = v.trade)""",
    ("projects", "lines"),
)
def _(t: Tables):
    return diagnostics.missing_trades(t.projects, boq.trade_summary(t.lines))


@query(
    "j08_project_header",
    f"""SELECT p.id AS project_id, p.name, coalesce(p.client, '') AS client, {sum_money_sql('b.total')} AS total
    FROM projects p LEFT JOIN bill b ON b.project_id = p.id GROUP BY 1, 2, 3""",
    ("projects", "bill"),
)
def _(t: Tables):
    totals = boq.project_totals(boq.trade_summary(t.bill))
    head = t.projects.select(F.col("id").alias("project_id"), "name", F.coalesce("client", F.lit("")).alias("client"))
    return head.join(totals.select("project_id", "total"), "project_id", "left")


@query(
    "j09_orphans",
    """SELECT reference, CAST(key AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS rows FROM (
      SELECT 'drawings.project' AS reference, project_id AS key FROM drawings WHERE project_id NOT IN (SELECT id FROM projects WHERE status <> 'sent')
      UNION ALL SELECT 'lines.project', project_id FROM bill WHERE project_id NOT IN (SELECT id FROM projects WHERE status <> 'sent')
      UNION ALL SELECT 'lines.rule', rule_id FROM bill WHERE rule_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 9)
      UNION ALL SELECT 'objects.drawing', drawing_id FROM objects WHERE drawing_id NOT IN (SELECT id FROM drawings WHERE status <> 'uploaded')
      UNION ALL SELECT 'objects.project', project_id FROM objects WHERE project_id NOT IN (SELECT id FROM projects WHERE status <> 'sent')
      UNION ALL SELECT 'lines.drawing', drawing_id FROM bill WHERE drawing_id NOT IN (SELECT id FROM drawings WHERE status <> 'uploaded')
      UNION ALL SELECT 'versions.project', project_id FROM versions WHERE project_id NOT IN (SELECT id FROM projects)) GROUP BY 1, 2""",
    ("projects", "drawings", "bill", "objects", "versions"),
)
def _(t: Tables):
    kept = t.projects.where(F.col("status") != "sent")
    drawings = t.drawings.where(F.col("status") != "uploaded")
    rules = t.raw("part").where(F.col("p_size") > 9).select(F.col("p_partkey").alias("id"))
    return quality.all_of(
        [
            quality.orphans(t.drawings, "project_id", kept, "id", "drawings.project"),
            quality.orphans(t.bill, "project_id", kept, "id", "lines.project"),
            quality.orphans(t.bill, "rule_id", rules, "id", "lines.rule"),
            quality.orphans(t.objects, "drawing_id", drawings, "id", "objects.drawing"),
            quality.orphans(t.objects, "project_id", kept, "id", "objects.project"),
            quality.orphans(t.bill, "drawing_id", drawings, "id", "lines.drawing"),
            quality.orphans(t.versions, "project_id", t.projects, "id", "versions.project"),
        ]
    )


@query(
    "j10_unmapped_rates",
    """SELECT trade, CAST(count(*) AS BIGINT) AS uses FROM lines WHERE trade NOT IN (SELECT trade FROM labour) GROUP BY 1""",
    ("lines", "labour"),
)
def _(t: Tables):
    return materials.unmapped_rates(t.lines, t.labour(), "trade")


@query(
    "j11_derivations",
    """SELECT b.id, b.project_id, b.total, '{"rule_id":"' || p_name || '","rule_description":"' || p_type || '"' ||
      CASE WHEN d.status <> 'uploaded' THEN ',"source_objects":[{"object_type":"' || d.status || '","id":' || b.id || ',"area":2.5}]' ELSE '' END || '}' AS derivation
    FROM bill b JOIN part ON p_partkey = rule_id JOIN drawings d ON d.id = b.id""",
    ("bill", "drawings"),
)
def _(t: Tables):
    rules = t.raw("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("key"), F.col("p_type").alias("material")
    )
    objects = t.drawings.where(F.col("status") != "uploaded").select(
        "id", F.col("status").alias("object_type"), F.lit(2.5).alias("quantity_estimate")
    )
    lines = t.bill.withColumn("detected_object_id", F.col("id"))
    return derive.derivations(lines, rules, objects)


@query(
    "j12_category_heights",
    f"""SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(any_value({_HEIGHTS_SQL}) AS DOUBLE) AS height3d
    FROM (SELECT {_CATEGORY_SQL} AS category FROM events) GROUP BY 1""",
)
def _(t: Tables):
    styled = ingest.with_attributes(_kinds(t), CATEGORY_ATTRIBUTES)
    return styled.groupBy("category").agg(F.count("*").alias("n"), F.any_value("height3d").alias("height3d"))


@query(
    "j13_fallback_detections",
    """SELECT drawing_id, 'template' AS origin, CAST(20 AS BIGINT) AS objects, CAST(147 AS DOUBLE) AS estimate
      FROM (SELECT event_id AS drawing_id FROM events WHERE event_id % 10 = 3)
    UNION ALL SELECT drawing_id, 'response', count(*), CAST(sum(quantity_estimate) AS DOUBLE) FROM detections GROUP BY 1""",
    ("detections",),
)
def _(t: Tables):
    asked = t.responses
    found = detections.explode_detections(asked, first=200)
    all_rows = ingest.with_fallback(asked, found)
    return all_rows.groupBy("drawing_id", "origin").agg(
        F.count("*").alias("objects"),
        F.sum("o.quantity_estimate").alias("estimate"),
    )


@query(
    "j14_labour_costs",
    f"""SELECT l.drawing_id, l.trade, l.quantity, r.rate AS labour_rate, {money_sql('l.quantity * coalesce(r.rate, 0.0)')} AS labour_cost
    FROM lines l LEFT JOIN labour r ON r.trade = l.trade""",
    ("lines", "labour"),
)
def _(t: Tables):
    return materials.labour_costs(t.lines, t.labour()).select(
        "drawing_id", "trade", "quantity", "labour_rate", "labour_cost"
    )


_OBSERVED_SQL = """expected AS (SELECT o_custkey AS project_id, p_type AS category, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
    observed AS (SELECT o_custkey AS project_id, p_type AS category, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1, 2),
    compared AS (SELECT project_id, category, coalesce(e.n, 0) AS expected, coalesce(o.n, 0) AS observed
      FROM expected e FULL JOIN observed o USING (project_id, category))"""


def _compared(t: Tables):
    joined = (
        t.raw("lineitem")
        .join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("project_id"), F.col("p_type").alias("category"), "l_returnflag", "l_linestatus")
    )

    def counted(condition):
        return joined.where(condition).groupBy("project_id", "category").agg(F.count("*").alias("n"))

    return evaluate.compare_counts(
        counted(F.col("l_returnflag") != "R"), counted(F.col("l_linestatus") == "F"), ["project_id", "category"]
    )


@query(
    "j16_expected_counts",
    f"""WITH {_OBSERVED_SQL} SELECT project_id, category, CAST(expected AS BIGINT) AS expected, CAST(observed AS BIGINT) AS observed,
    CAST(observed - expected AS BIGINT) AS difference, observed = expected AS matches FROM compared""",
)
def _(t: Tables):
    return _compared(t)


def _offers(t: Tables, status: str):
    """One of two sides that together hold every row."""
    rows = t.raw("lineitem").where(F.col("l_linestatus") == status)
    return rows.select(F.col("l_partkey").alias("material_id"), F.col("l_suppkey").alias("vendor_id"))


def _offers_sql(status: str) -> str:
    return f"SELECT l_partkey AS material_id, l_suppkey AS vendor_id FROM lineitem WHERE l_linestatus = '{status}'"


@query(
    "j17_reconcile",
    f"""SELECT *, 'missing' AS side FROM ({_offers_sql('F')} EXCEPT {_offers_sql('O')})
    UNION ALL SELECT *, 'unexpected' FROM ({_offers_sql('O')} EXCEPT {_offers_sql('F')})""",
)
def _(t: Tables):
    return evaluate.reconcile(_offers(t, "F"), _offers(t, "O"), ["material_id", "vendor_id"])


# ------------------------------------------------------------------ aggregations


@query(
    "a01_trade_summary",
    f"""SELECT project_id, coalesce(trade, 'Misc') AS trade, {sum_money_sql('total')} AS total, CAST(count(*) AS BIGINT) AS count
    FROM lines GROUP BY 1, 2""",
    ("lines",),
)
def _(t: Tables):
    return boq.trade_summary(t.lines)


@query(
    "a02_project_totals",
    f"""SELECT project_id, {sum_money_sql('total')} AS total, CAST(count(DISTINCT trade) AS BIGINT) AS trades,
    CAST(count(*) AS BIGINT) AS lines FROM lines GROUP BY 1""",
    ("lines",),
)
def _(t: Tables):
    return boq.project_totals(boq.trade_summary(t.lines))


@query("a03_cost_rollup", "SELECT project_id, " + _ROLL_SQL.format(source="lines"), ("lines",))
def _(t: Tables):
    return costing.cost_rollup(boq.project_totals(boq.trade_summary(t.lines)))


@query(
    "a04_drawing_status",
    """SELECT d.id AS drawing_id, d.status, CAST(count(o.drawing_id) AS BIGINT) AS objects_detected
    FROM drawings d LEFT JOIN objects o ON o.drawing_id = d.id GROUP BY 1, 2""",
    ("drawings", "objects"),
)
def _(t: Tables):
    return ingest.drawing_status(t.drawings, t.objects)


@query(
    "a05_type_counts",
    """SELECT project_id, CAST(count_if(object_type = 'STANDARD') AS BIGINT) AS n_standard, CAST(count_if(object_type = 'SMALL') AS BIGINT) AS n_small,
    CAST(count(*) AS BIGINT) AS n_all FROM objects GROUP BY 1""",
    ("objects",),
)
def _(t: Tables):
    return ingest.type_counts(t.objects, ["STANDARD", "SMALL"])


@query(
    "a06_portfolio",
    """SELECT client, CAST(count(*) AS BIGINT) AS total, CAST(count_if(status IN ('in_progress','priced')) AS BIGINT) AS in_progress,
    CAST(count_if(status = 'sent') AS BIGINT) AS sent,
    CAST(count_if(id IN (SELECT project_id FROM drawings WHERE status = 'detected')) AS BIGINT) AS with_drawings
    FROM projects GROUP BY 1""",
    ("projects", "drawings"),
)
def _(t: Tables):
    detected = t.drawings.where(F.col("status") == "detected")
    figures = derive.project_figures(t.projects, detected, boq.project_totals(boq.trade_summary(t.bill)))
    projects = t.projects.join(figures.select(F.col("project_id").alias("id"), "drawings_count"), "id")
    return derive.portfolio(projects, by="client")


@query(
    "a07_catalogue_counts",
    """SELECT category, CAST(count_if(is_preferred) AS BIGINT) AS preferred,
    CAST(count_if(contains(lower(name), 'ring') OR contains(lower(brand), 'ring') OR contains(lower(category), 'ring')) AS BIGINT) AS matching
    FROM materials GROUP BY 1""",
    ("materials",),
)
def _(t: Tables):
    return materials.catalogue_counts(t.materials, "ring")


@query(
    "a08_distinct_trades",
    "SELECT project_id, CAST(count(DISTINCT coalesce(trade, '?')) AS BIGINT) AS trades FROM bill GROUP BY 1",
    ("bill",),
)
def _(t: Tables):
    return boq.distinct_trades(t.bill)


_SUMMARY_SQL = f"""summary AS (SELECT project_id, coalesce(trade, 'Misc') AS trade, {sum_money_sql('total')} AS total,
    count(*) AS count FROM {{source}} GROUP BY 1, 2)"""


@query(
    "a09_trade_bars",
    "WITH " + _SUMMARY_SQL.format(source="bill") + """ SELECT project_id, trade, total, greatest(max(total) OVER w, 1.0) AS largest,
    greatest(2.0, total / greatest(max(total) OVER w, 1.0) * 100.0) AS bar_pct FROM summary WINDOW w AS (PARTITION BY project_id)""",
    ("bill",),
)
def _(t: Tables):
    return boq.trade_shares(boq.trade_summary(t.bill)).drop("share")


@query(
    "a10_plan_extents",
    """SELECT drawing_id, min_x, min_y, max_x, max_y, scale, (800.0 - w * scale) / 2 - min_x * scale AS offset_x,
    (600.0 - h * scale) / 2 - min_y * scale AS offset_y FROM (SELECT *, least(720.0 / w, 520.0 / h) AS scale FROM (
      SELECT *, greatest(1.0, max_x - min_x) AS w, greatest(1.0, max_y - min_y) AS h FROM (
        SELECT drawing_id, min(x * 15000) AS min_x, min(y * 10000) AS min_y, max(x * 15000 + confidence * 100) AS max_x,
        max(y * 10000 + 500) AS max_y FROM objects GROUP BY 1)))""",
    ("objects",),
)
def _(t: Tables):
    plan = t.objects.select(
        "drawing_id",
        (F.col("x") * 15_000).alias("bbox_x"),
        (F.col("y") * 10_000).alias("bbox_y"),
        (F.col("confidence") * 100).alias("length"),
        F.lit(500).alias("width"),
    )
    return ingest.fit_to_view(plan, 800.0, 600.0)


@query(
    "a11_truth_totals",
    f"""SELECT project_id, {sum_money_sql('coalesce(CASE WHEN computed_given THEN computed_total ELSE expected_total END, 0)')} AS total, CAST(count(*) AS BIGINT) AS trades
    FROM truth GROUP BY 1""",
    ("truth",),
)
def _(t: Tables):
    docs = t.truth_documents.withColumn("truth", fixtures.parse_truth(F.col("text")))
    return evaluate.truth_totals(fixtures.truth_trades(docs))


@query(
    "a12_tolerance_gate",
    f"""SELECT *, delta_pct <= 1.0 AS passed FROM (SELECT project_id, actual, expected,
      CASE WHEN expected > 0 THEN abs(actual - expected) / expected * 100.0 ELSE 100.0 END AS delta_pct FROM (
        SELECT l_orderkey AS project_id, {sum_money_sql('l_extendedprice')} AS actual,
        {sum_money_sql('l_extendedprice * (1.0 - l_discount / 5.0) - 9000.0')} AS expected FROM lineitem GROUP BY 1))""",
)
def _(t: Tables):
    compared = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(
        N.sum_money(F.col("l_extendedprice")).alias("actual"),
        N.sum_money(F.col("l_extendedprice") * (1.0 - F.col("l_discount") / 5.0) - 9000.0).alias("expected"),
    )
    return evaluate.tolerance_gate(compared)


@query(
    "a13_structure_check",
    """SELECT project_id, CAST(trades AS BIGINT) AS trades, CAST(items AS BIGINT) AS items, project_id % 2 = 0 AS delta_pass,
    trades = 8 AS trades_pass, items = 40 AS items_pass, project_id % 2 = 0 AND trades = 8 AS passed
    FROM (SELECT project_id, count(DISTINCT trade) AS trades, count(*) AS items FROM lines GROUP BY 1)""",
    ("lines",),
)
def _(t: Tables):
    counts = evaluate.structure_counts(t.lines.select("project_id", "trade"), "project_id")
    return evaluate.structure_check(counts.withColumn("delta_pass", F.col("project_id") % 2 == 0), 8, 40)


_SCENARIO_SQL = """scenarios AS (SELECT project_id, trade, bool_and(total > 100) AS passed, bool_or(rate > 80000 AND quantity > 1) AS skipped,
    count_if(total < 50) AS errors FROM lines GROUP BY 1, 2)"""


@query(
    "a16_scenario_rollup",
    f"""WITH {_SCENARIO_SQL} SELECT project_id, CAST(count(*) AS BIGINT) AS scenarios, bool_and(passed) AS all_passed,
    bool_or(skipped) AS any_skipped, CAST(sum(errors) AS BIGINT) AS errors,
    CASE WHEN bool_and(passed) AND bool_or(skipped) THEN 'partial' WHEN bool_and(passed) THEN 'validated'
      WHEN sum(errors) > 0 THEN 'error' WHEN bool_or(skipped) THEN 'structural failure' ELSE 'overfit' END AS verdict
    FROM scenarios GROUP BY 1""",
    ("lines",),
)
def _(t: Tables):
    scenarios = t.lines.groupBy("project_id", "trade").agg(
        F.bool_and(F.col("total") > 100).alias("passed"),
        F.bool_or((F.col("rate") > 80000) & (F.col("quantity") > 1)).alias("skipped"),
        F.count_if(F.col("total") < 50).alias("errors"),
    )
    return evaluate.scenario_rollup(scenarios, "project_id")


@query(
    "a17_trade_outliers",
    "WITH " + _SUMMARY_SQL.format(source="lines")
    + f""", averaged AS (SELECT *, CAST(sum(CAST(floor(total * 100.0 + 0.5) AS BIGINT)) OVER w AS DOUBLE) / 100.0 / count(*) OVER w AS average
      FROM summary WINDOW w AS (PARTITION BY project_id))
    SELECT project_id, trade, count || ' items, ₹' || {indian_sql(f"CAST({half_up_sql('total')} AS VARCHAR)")} AS line,
    {half_up_sql('average')} AS expected, {half_up_sql('total')} AS got,
    CASE WHEN total > average * 5 THEN 'high' ELSE 'med' END AS severity FROM averaged WHERE total > average * 3""",
    ("lines",),
)
def _(t: Tables):
    return diagnostics.trade_outliers(boq.trade_summary(t.lines))


@query(
    "a18_absolute_outliers",
    "WITH " + _SUMMARY_SQL.format(source="lines")
    + f""", averaged AS (SELECT *, CAST(sum(CAST(floor(total * 100.0 + 0.5) AS BIGINT)) OVER w AS DOUBLE) / 100.0 / count(*) OVER w AS average
      FROM summary WINDOW w AS (PARTITION BY project_id))
    SELECT project_id, trade, {half_up_sql('average')} AS expected, {half_up_sql('total')} AS got,
    CASE WHEN total > 1500000 THEN 'high' ELSE 'med' END AS severity FROM averaged WHERE total > 700000""",
    ("lines",),
)
def _(t: Tables):
    return diagnostics.absolute_outliers(boq.trade_summary(t.lines))


@query(
    "a19_value_engineering",
    "WITH " + _SUMMARY_SQL.format(source="lines")
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY total DESC, trade) AS rank FROM summary)
    SELECT project_id, rank, trade, 'Switch one premium material in ' || trade || ' to a standard alternative (~5% saving).' AS change,
    {half_up_sql('total * 0.05')} AS saving,
    {half_up_sql('sum(total * 0.05) OVER (PARTITION BY project_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS total_saving
    FROM ranked WHERE rank <= 3""",
    ("lines",),
)
def _(t: Tables):
    return diagnostics.value_engineering(boq.trade_summary(t.lines))


_INR = indian_sql(f"CAST({half_up_sql('total')} AS VARCHAR)")


@query(
    "a20_bill_context",
    f"""WITH summary AS (SELECT project_id, coalesce(trade, 'Misc') AS trade, {sum_money_sql('total')} AS total, count(*) AS n,
      min(id) AS first_id FROM bill GROUP BY 1, 2)
    SELECT project_id, string_agg(trade || ': ₹' || {_INR} || ' (' || n || ' items)', chr(10) ORDER BY first_id) AS context,
    array_to_string(list_slice(list(trade || ' total ₹' || {_INR} ORDER BY first_id), 1, 3), '; ') AS citations FROM summary GROUP BY 1""",
    ("bill",),
)
def _(t: Tables):
    context = diagnostics.bill_context(boq.trade_summary(t.bill, first_seen="id"), citations=3)
    return context.withColumn("citations", F.array_join("citations", "; "))


@query(
    "a21_purchase_list",
    f"""SELECT project_id, vendor_name, material_id, CAST(count(*) AS BIGINT) AS lines, {sum_quantity_sql('quantity')} AS quantity,
    {sum_money_sql('total')} AS total FROM purchases GROUP BY 1, 2, 3""",
    ("purchases",),
)
def _(t: Tables):
    return materials.purchase_list(t.purchases)


@query(
    "a22_materials_summary",
    f"""SELECT project_id, coalesce(material_name, '') AS material_name, CAST(count(*) AS BIGINT) AS lines, {sum_quantity_sql('quantity')} AS quantity,
    {sum_money_sql('total')} AS total FROM lines GROUP BY 1, 2""",
    ("lines",),
)
def _(t: Tables):
    return materials.materials_summary(t.lines)


@query(
    "a23_sections",
    f"""SELECT project_id, CASE WHEN grouping(trade) = 1 THEN 'Grand Total' ELSE trade END AS section, CAST(grouping(trade) AS BIGINT) AS level,
    CAST(count(*) AS BIGINT) AS lines, {sum_money_sql('total')} AS total
    FROM (SELECT project_id, coalesce(trade, 'Misc') AS trade, total FROM bill)
    GROUP BY GROUPING SETS ((project_id, trade), (project_id))""",
    ("bill",),
)
def _(t: Tables):
    return boq.sections(t.bill).withColumn("level", F.col("level").cast("long"))


@query("a24_status_histogram", "SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(t: Tables):
    return evaluate.status_counts(t.events.select(F.col("event_type").alias("status")))


@query(
    "a25_detection_quality",
    f"""WITH {_OBSERVED_SQL} SELECT category, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(observed) AS BIGINT) AS observed,
    CAST(sum(least(expected, observed)) AS BIGINT) AS found, sum(least(expected, observed))::DOUBLE / sum(observed)::DOUBLE AS precision,
    sum(least(expected, observed))::DOUBLE / sum(expected)::DOUBLE AS recall,
    sum(least(expected, observed))::DOUBLE * 2 / (sum(observed) + sum(expected))::DOUBLE AS f1 FROM compared GROUP BY 1""",
)
def _(t: Tables):
    return evaluate.detection_quality(_compared(t), "category")


@query(
    "a26_area_check",
    f"""SELECT *, delta_pct <= 5.0 AS passed FROM (SELECT drawing_id, expected, actual,
      CASE WHEN expected > 0 THEN abs(actual - expected) / expected * 100.0 ELSE 100.0 END AS delta_pct FROM (
        SELECT o_orderkey AS drawing_id, CAST(o_orderkey % 200 AS DOUBLE) AS expected, coalesce({sum_quantity_sql('l_quantity * 1.5')}, 0.0) AS actual
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2))""",
)
def _(t: Tables):
    rooms = t.raw("lineitem").select(F.col("l_orderkey").alias("drawing_id"), (F.col("l_quantity") * 1.5).alias("area"))
    stated = t.raw("orders").select(
        F.col("o_orderkey").alias("drawing_id"), (F.col("o_orderkey") % 200).cast("double").alias("area")
    )
    return evaluate.area_check(rooms, stated, "drawing_id")


_WASTE_SQL = "CASE material_name " + " ".join(f"WHEN '{m}' THEN {p}" for m, p in WASTAGE) + " ELSE 0.0 END"


@query(
    "a27_wastage",
    f"""SELECT project_id, material_name, {sum_quantity_sql(f'quantity * (1.0 + CAST({_WASTE_SQL} AS DOUBLE) / 100.0)')} AS quantity
    FROM lines GROUP BY 1, 2""",
    ("lines",),
)
def _(t: Tables):
    raised = materials.with_wastage(t.lines, t.wastage())
    return raised.groupBy("project_id", "material_name").agg(
        N.sum_quantity(F.col("quantity_with_wastage")).alias("quantity")
    )


_DAYS_SQL = f"""days AS (SELECT project_id, l.trade, {sum_quantity_sql('quantity')} AS quantity,
    CASE WHEN any_value(productivity) > 0 THEN {sum_quantity_sql('quantity')} / any_value(productivity) END AS days
    FROM lines l LEFT JOIN labour r ON r.trade = l.trade GROUP BY 1, 2)"""


@query("a28_trade_durations", f"WITH {_DAYS_SQL} SELECT * FROM days", ("lines", "labour"))
def _(t: Tables):
    return materials.durations(t.lines, t.labour())


@query(
    "a28_project_durations",
    f"""WITH {_DAYS_SQL} SELECT project_id, CAST(sum(CAST(floor(days * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000.0 AS days_in_sequence,
    CAST(max(CAST(floor(days * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / 10000.0 AS days_in_parallel FROM days GROUP BY 1""",
    ("lines", "labour"),
)
def _(t: Tables):
    return materials.project_durations(materials.durations(t.lines, t.labour()))


@query(
    "a29_run_spend",
    f"""SELECT user_id AS run_id, arg_min(k, (ts, event_id)) AS first_calls, arg_min(value, (ts, event_id)) AS first_spend,
    CAST(sum(k) AS BIGINT) AS calls, {sum_money_sql('value')} AS spend
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def _(t: Tables):
    usage = t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("ts").alias("iteration"),
        F.col("event_id").alias("entry_id"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("calls"),
        F.col("value").alias("spend"),
    )
    return evaluate.run_spend(usage)


@query(
    "a30_project_figures",
    f"""SELECT p.id AS project_id, CAST(coalesce(d.n, 0) AS BIGINT) AS drawings_count, b.total FROM projects p
    LEFT JOIN (SELECT project_id, count(*) AS n FROM drawings GROUP BY 1) d ON d.project_id = p.id
    LEFT JOIN (SELECT project_id, {sum_money_sql('total')} AS total FROM lines GROUP BY 1) b ON b.project_id = p.id""",
    ("projects", "drawings", "lines"),
)
def _(t: Tables):
    return derive.project_figures(t.projects, t.drawings, boq.project_totals(boq.trade_summary(t.lines)))


@query(
    "full_estimate",
    "WITH " + _SUMMARY_SQL.format(source="lines")
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY total DESC, trade) AS rank,
        CAST(sum(CAST(floor(total * 100.0 + 0.5) AS BIGINT)) OVER w AS DOUBLE) / 100.0 / count(*) OVER w AS average
      FROM summary WINDOW w AS (PARTITION BY project_id)),
    gaps AS (SELECT p.id AS project_id, count(*) AS missing FROM projects p CROSS JOIN {_TYPICAL_SQL}
      WHERE NOT EXISTS (SELECT 1 FROM summary s WHERE s.project_id = p.id AND s.trade = v.trade) GROUP BY 1),
    costs AS (SELECT project_id, {_ROLL_SQL.format(source='lines')})
    SELECT c.project_id, CAST(count(*) AS BIGINT) AS trades, CAST(sum(r.count) AS BIGINT) AS lines, any_value(c.materials_total) AS materials_total,
    any_value(c.total) AS total, CAST(coalesce(any_value(g.missing), 0) AS BIGINT) AS missing,
    CAST(count_if(r.total > r.average * 3) AS BIGINT) AS outliers,
    {half_up_sql('sum(r.total * 0.05 ORDER BY r.rank) FILTER (WHERE r.rank <= 3)')} AS total_saving
    FROM costs c JOIN ranked r ON r.project_id = c.project_id LEFT JOIN gaps g ON g.project_id = c.project_id GROUP BY 1""",
    ("lines", "projects"),
)
def _(t: Tables):
    return overview(estimate(t.objects, t.projects, BOUND_RULES, buckets=8))


# ------------------------------------------------------------------ windows


@query(
    "w01_line_numbers",
    """SELECT id, project_id, coalesce(trade, 'Misc') AS trade,
    row_number() OVER (PARTITION BY project_id, coalesce(trade, 'Misc') ORDER BY id) AS line_number FROM bill""",
    ("bill",),
)
def _(t: Tables):
    return boq.line_numbers(t.bill.select("id", "project_id", "trade"), block_width=4_000)


@query(
    "w02_version_history",
    f"""SELECT id, project_id, version_label, total, row_number() OVER w AS position, row_number() OVER w = 1 AS active
    FROM versions WINDOW w AS (PARTITION BY project_id ORDER BY created_at DESC, id DESC)""",
    ("versions",),
)
def _(t: Tables):
    return costing.version_history(t.versions).drop("created_at")


@query(
    "w02_latest_version",
    """SELECT project_id, CAST(count(*) AS BIGINT) AS versions, arg_max(id, (created_at, id)) AS id,
    arg_max(total, (created_at, id)) AS total FROM versions GROUP BY 1""",
    ("versions",),
)
def _(t: Tables):
    return costing.latest_versions(t.versions).select("project_id", "versions", "id", "total")


@query(
    "w03_version_changes",
    f"""SELECT id, project_id, total, previous_total, {money_sql('total - previous_total')} AS change FROM (
      SELECT *, lag(total) OVER (PARTITION BY project_id ORDER BY created_at, id) AS previous_total FROM versions)""",
    ("versions",),
)
def _(t: Tables):
    return costing.version_changes(t.versions).drop("created_at", "version_label")


@query(
    "w04_rate_history",
    f"""SELECT material_id, rate, lag(rate) OVER w AS previous_rate, {stamp_sql('valid_from')} AS valid_from,
    {stamp_sql('lead(valid_from) OVER w')} AS valid_to, lead(valid_from) OVER w IS NULL AS is_current
    FROM rates WINDOW w AS (PARTITION BY material_id ORDER BY valid_from)""",
    ("rates",),
)
def _(t: Tables):
    return costing.rate_history(t.rates).withColumns(
        {"valid_from": stamp("valid_from"), "valid_to": stamp("valid_to")}
    )


@query(
    "w05_top_trades",
    "WITH " + _SUMMARY_SQL.format(source="lines") + """ SELECT project_id, trade, total, CAST(count AS BIGINT) AS count, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY total DESC, trade) AS rank FROM summary) WHERE rank <= 3""",
    ("lines",),
)
def _(t: Tables):
    return boq.top_trades(boq.trade_summary(t.lines))


@query(
    "w06_first_match",
    """SELECT label, key FROM (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY priority) AS r
    FROM (SELECT DISTINCT label FROM objects) JOIN overrides ON contains(lower(label), key)) WHERE r = 1""",
    ("objects", "overrides"),
)
def _(t: Tables):
    labels = t.objects.select("label").distinct()
    rows = BOUND_RULES.overrides_table(t.spark).collect()
    first = expand.first_override(F.col("label"), rows)
    return labels.select("label", first["key"].alias("key")).where(F.col("key").isNotNull())


@query(
    "w07_trade_average",
    "WITH " + _SUMMARY_SQL.format(source="bill") + """ SELECT project_id, trade, total, CAST(count AS BIGINT) AS count,
    CAST(sum(CAST(floor(total * 100.0 + 0.5) AS BIGINT)) OVER w AS DOUBLE) / 100.0 / count(*) OVER w AS average
    FROM summary WINDOW w AS (PARTITION BY project_id)""",
    ("bill",),
)
def _(t: Tables):
    return diagnostics.with_trade_average(boq.trade_summary(t.bill))


@query(
    "w08_trade_share",
    "WITH " + _SUMMARY_SQL.format(source="bill") + """ SELECT project_id, trade,
    total / nullif(CAST(sum(CAST(floor(total * 100.0 + 0.5) AS BIGINT)) OVER (PARTITION BY project_id) AS DOUBLE) / 100.0, 0) AS share FROM summary""",
    ("bill",),
)
def _(t: Tables):
    return boq.trade_shares(boq.trade_summary(t.bill)).select("project_id", "trade", "share")


@query(
    "w09_position_cap",
    "SELECT drawing_id, CAST(count(*) AS BIGINT) AS kept FROM detections WHERE pos < 2 GROUP BY 1",
    ("detections",),
)
def _(t: Tables):
    return detections.explode_detections(t.responses, first=2).groupBy("drawing_id").agg(F.count("*").alias("kept"))


@query(
    "w10_entity_numbers",
    """SELECT CAST(o_custkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entity_no,
    CAST(o_orderkey % 1000 AS DOUBLE) AS x FROM orders""",
)
def _(t: Tables):
    return cad.entities(t.cad_lines, block_width=10_000).select("file", "entity_no", "x")


@query(
    "w11_failure_runs",
    f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id)
      - row_number() OVER (PARTITION BY key, failed ORDER BY ts, event_id) AS island FROM log),
    runs AS (SELECT key, island, min(ts) AS started, count(*) AS failures, (list(ts ORDER BY ts, event_id))[3] AS opened
      FROM numbered WHERE failed GROUP BY 1, 2)
    SELECT key, {stamp_sql('started')} AS started, CAST(failures AS BIGINT) AS failures, {stamp_sql('opened')} AS opened,
    {stamp_sql('opened + to_seconds(30)')} AS closes FROM runs WHERE failures >= 3""",
    ("log",),
)
def _(t: Tables):
    runs = deadlines.failure_runs(t.log)
    return runs.withColumns({c: stamp(c) for c in ("started", "opened", "closes")})


# ------------------------------------------------------------------ orders and sets


@query(
    "o01_newest_first",
    f"SELECT id, project_id, {stamp_sql('created_at')} AS created_at FROM drawings ORDER BY drawings.created_at DESC, id DESC",
    ("drawings",),
)
def _(t: Tables):
    return maintenance.newest_first(t.drawings).select("id", "project_id", stamp("created_at").alias("created_at"))


@query("o02_by_trade", "SELECT id, trade, total FROM bill ORDER BY trade NULLS LAST, id", ("bill",))
def _(t: Tables):
    return maintenance.by_name(t.bill, "trade").select("id", "trade", "total")


@query(
    "o03_limited_page",
    "SELECT id, name FROM materials WHERE active ORDER BY name NULLS LAST, id LIMIT 20",
    ("materials",),
)
def _(t: Tables):
    return materials.search(t.materials.where(F.col("active")), limit=20).select("id", "name")


@query(
    "o04_first_deliverables",
    """SELECT project_id, id, rank FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank
    FROM versions) WHERE rank <= 12""",
    ("versions",),
)
def _(t: Tables):
    history = costing.version_history(t.versions)
    return history.where(F.col("position") <= 12).select("project_id", "id", F.col("position").alias("rank"))


@query(
    "o05_slowest_steps",
    """SELECT route, CAST(count(*) AS BIGINT) AS calls, max(latency) AS slowest FROM log GROUP BY 1 ORDER BY slowest DESC""",
    ("log",),
)
def _(t: Tables):
    steps = t.log.groupBy("route").agg(F.count("*").alias("calls"), F.max("latency").alias("slowest"))
    return steps.orderBy(F.desc("slowest"), "route")


@query(
    "o06_first_seen_order",
    f"""SELECT project_id, trade, total, count, first_id, row_number() OVER (PARTITION BY project_id ORDER BY first_id) AS position FROM (
      SELECT project_id, coalesce(trade, 'Misc') AS trade, {sum_money_sql('total')} AS total, CAST(count(*) AS BIGINT) AS count, min(id) AS first_id
      FROM bill GROUP BY 1, 2)""",
    ("bill",),
)
def _(t: Tables):
    return boq.in_group_order(boq.trade_summary(t.bill, first_seen="id"))


@query(
    "e01_trade_difference",
    f"""SELECT trade FROM {_TYPICAL_SQL} EXCEPT SELECT trade FROM bill""",
    ("bill",),
)
def _(t: Tables):
    typical = literal_table(t.spark, [(name,) for name in TYPICAL_TRADES], "trade string")
    return evaluate.difference(typical, t.bill, ["trade"])


@query("e02_distinct_values", "SELECT DISTINCT trade, unit FROM bill", ("bill",))
def _(t: Tables):
    return t.bill.select("trade", "unit").distinct()


@query("e03_overlap", f"{_offers_sql('F')} INTERSECT {_offers_sql('O')}")
def _(t: Tables):
    return evaluate.overlap(_offers(t, "F"), _offers(t, "O"), ["material_id", "vendor_id"])


@query(
    "e04_union_of_kept",
    """SELECT id, project_id, total FROM bill WHERE project_id NOT IN (SELECT id FROM projects WHERE status = 'draft')
    UNION ALL SELECT id, project_id, 0.0 FROM bill WHERE project_id IN (SELECT id FROM projects WHERE status = 'draft')""",
    ("bill", "projects"),
)
def _(t: Tables):
    scope = t.projects.where(F.col("status") == "draft").select(F.col("id").alias("project_id"))
    old = t.bill.select("id", "project_id", "total")
    new = maintenance.in_scope(old, scope, ["project_id"]).withColumn("total", F.lit(0.0))
    return maintenance.replaced(old, new, scope, ["project_id"])


@query(
    "e05_detections_or_template",
    """SELECT object_type, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT coalesce(object_type, 'unknown') AS object_type, count(*) AS n FROM detections GROUP BY 1
      UNION ALL SELECT k, c * (SELECT count(*) FROM events WHERE event_id % 10 = 3) FROM (VALUES ('cabin',3),('door',2),('furniture',3),('partition',2),
        ('ceiling',1),('electrical',3),('window',2),('wall',2),('column',2)) v(k, c)) GROUP BY 1""",
    ("detections",),
)
def _(t: Tables):
    asked = t.responses
    rows = ingest.normalised(ingest.with_fallback(asked, detections.explode_detections(asked, first=200)), 0.7)
    return rows.groupBy("object_type").agg(F.count("*").alias("n"))


@query(
    "e06_distinct_contents",
    """SELECT sha256(text) AS sha256, min(source || '/' || doc_id || '.txt') AS path, CAST(count(*) AS BIGINT) AS copies
    FROM documents GROUP BY 1""",
)
def _(t: Tables):
    return files.first_of_each_content(files.manifest(t.uploads))


# ------------------------------------------------------------------ operators on the engine's own lines


def _kept_lines(t: Tables):
    """The expanded lines after the lines of draft projects were replaced by their expansion again."""
    scope = t.projects.where(F.col("status") == "draft").select(F.col("id").alias("project_id"))
    lines = t.lines
    return maintenance.replaced(lines, maintenance.in_scope(lines, scope, ["project_id"]), scope, ["project_id"])


@query(
    "chain_line_numbers",
    """SELECT project_id, trade, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS last_number,
    CAST(count(*) AS BIGINT) AS ids FROM lines GROUP BY 1, 2""",
    ("lines",),
)
def _(t: Tables):
    numbered = boq.line_numbers(_kept_lines(t).select("id", "project_id", "trade"), block_width=1 << 60)
    return numbered.groupBy("project_id", "trade").agg(
        F.count("*").alias("lines"), F.max("line_number").alias("last_number"), F.count_distinct("id").alias("ids")
    )


@query(
    "chain_bill_sheet",
    f"""SELECT p.id AS project_id, CAST(count(l.total) + 6 AS BIGINT) AS rows,
    coalesce({sum_money_sql('l.total')}, 0.0) AS total FROM projects p LEFT JOIN lines l ON l.project_id = p.id GROUP BY 1""",
    ("projects", "lines"),
)
def _(t: Tables):
    sheet = export.bill_sheet(_kept_lines(t), t.projects, datetime(2024, 6, 1, tzinfo=UTC), block_width=1 << 60)
    total = F.regexp_extract("text", r"^,,,,Grand Total,(.*)$", 1)
    return sheet.groupBy("project_id").agg(
        F.count("*").alias("rows"),
        F.max(F.when(total != "", F.replace(F.replace(total, F.lit('"'), F.lit("")), F.lit(","), F.lit("")).cast("double"))).alias("total"),
    )
