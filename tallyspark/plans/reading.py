"""Queries of sources, sinks, projections and filters."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tallyspark.functions import numbers as N
from tallyspark.functions import text as X
from tallyspark.functions import web as U
from tallyspark.operators import boq, costing, export, ingest, maintenance, materials, quality
from tallyspark.operators.expand import expand_lines, line_quantity
from tallyspark.operators.evaluate import check_report, real_items
from tallyspark.plans.bindings import (
    BOUND_RULES,
    LINE_SPAN_SQL,
    Tables,
    half_up_sql,
    money_sql,
    pick_sql,
    sum_money_sql,
    sum_quantity_sql,
)
from tallyspark.plans.estimate import create_store, replace_lines
from tallyspark.plans.registry import indian_sql, query, stamp, stamp_sql
from tallyspark.session import new_path
from tallyspark.sources import cad, detections, files, fixtures, snapshots

CLOCK = datetime(2024, 6, 1, 12, 0, 0, 250000, tzinfo=UTC)
CLOCK_MS = 1717243200250

# ------------------------------------------------------------------ sources


@query(
    "s01_projects_scan",
    f"SELECT id, name, client, status, balance, {stamp_sql('created_at')} AS created_at FROM projects",
    ("projects",),
)
def _(t: Tables):
    return t.projects.select("id", "name", "client", "status", "balance", stamp("created_at").alias("created_at"))


@query(
    "s02_pruned_scan",
    f"SELECT id, status, {stamp_sql('detected_at')} AS detected_at FROM drawings",
    ("drawings",),
)
def _(t: Tables):
    return t.drawings.select("id", "status", stamp("detected_at").alias("detected_at"))


@query(
    "s03_scoped_scan",
    """SELECT d.id, d.project_id, d.name FROM drawings d
    WHERE d.project_id IN (SELECT id FROM projects WHERE client = 'BUILDING')""",
    ("drawings", "projects"),
)
def _(t: Tables):
    scope = t.projects.where(F.col("client") == "BUILDING").select(F.col("id").alias("project_id"))
    return maintenance.in_scope(t.drawings.select("id", "project_id", "name"), scope, ["project_id"])


@query(
    "s04_single_lookup",
    """SELECT o_orderkey AS drawing_id, CAST(count(l_orderkey) AS BIGINT) AS found,
    CASE count(l_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS state
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t: Tables):
    keys = t.raw("orders").select(F.col("o_orderkey").alias("drawing_id"))
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("drawing_id"))
    return maintenance.lookup(keys, rows, "drawing_id")


@query(
    "s05_object_counts",
    "SELECT drawing_id, CAST(count(*) AS BIGINT) AS objects FROM objects GROUP BY 1",
    ("objects",),
)
def _(t: Tables):
    return ingest.object_counts(t.objects)


_DETECTION_SQL = """SELECT project_id, drawing_id, CAST(pos AS BIGINT) AS pos, coalesce(object_type, 'unknown') AS object_type,
    label, {confidence} AS confidence, CAST(quantity_estimate AS DOUBLE) AS quantity_estimate, trade, unit,
    CASE WHEN pos = 0 THEN 0.125 END AS w, CASE WHEN pos = 0 THEN 0.75 END AS h, '{source}' AS detection_source FROM detections"""


def _flat(detected):
    return detected.select(
        "project_id", "drawing_id", F.col("pos").cast("long").alias("pos"), "object_type", "label", "confidence",
        "quantity_estimate", "trade", "unit", F.col("bbox.width").alias("w"), F.col("bbox.height").alias("h"),
        "detection_source",
    )


@query(
    "s06_parse_responses",
    """SELECT project_id, drawing_id, CAST(pos AS BIGINT) AS pos, object_type, label, trade, unit,
    CAST(confidence AS DOUBLE) AS confidence FROM detections""",
    ("detections",),
)
def _(t: Tables):
    found = detections.explode_detections(t.responses)
    return found.select(
        "project_id", "drawing_id", F.col("pos").cast("long").alias("pos"), "o.object_type", "o.label", "o.trade",
        "o.unit", "o.confidence",
    )


@query(
    "s07_rule_coverage",
    """SELECT object_type, CAST(n AS BIGINT) AS objects, trade, unit, rate FROM
    (SELECT object_type, count(*) AS n FROM objects GROUP BY 1) LEFT JOIN rules USING (object_type)""",
    ("objects", "rules"),
)
def _(t: Tables):
    return ingest.rule_coverage(t.objects, BOUND_RULES.rules_table(t.spark))


@query(
    "s08_file_manifest",
    """SELECT source || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, 'txt' AS extension,
    CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents""",
)
def _(t: Tables):
    return files.manifest(t.uploads).drop("head")


@query(
    "s09_cad_layers",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS file, {pick_sql('o_orderkey % 3', ('A-WALL', 'A-DOOR', 'A-ANNO-TEXT'))} AS layer,
    {pick_sql('o_orderkey % 4', ('LINE', 'ARC', 'INSERT', 'TEXT'))} AS entity, CAST(count(*) AS BIGINT) AS entities,
    CAST(min(o_orderkey % 1000) AS DOUBLE) AS min_x, max(o_orderkey % 77 + 0.5)::DOUBLE AS max_y FROM orders GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    found = cad.entities(t.cad_lines)
    return found.groupBy("file", "layer", "entity").agg(
        F.count("*").alias("entities"), F.min("x").alias("min_x"), F.max("y").alias("max_y")
    )


@query(
    "s10_json_fixture",
    "SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY 1, 2",
)
def _(t: Tables):
    path = new_path(t.spark, "fixture-json")
    t.raw("labels").write.json(path)
    rows = fixtures.read_records(t.spark, path, "doc_id long, quality long, toxic long")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    "s11_nested_truth",
    """SELECT project_id, trade, CAST(1 AS BIGINT) AS item_no, amount, 'a * 2' AS formula, CAST(3 AS DOUBLE) AS rate
      FROM truth WHERE trade = 'Civil'
    UNION ALL SELECT project_id, trade, 0, 0.0, NULL, NULL FROM truth WHERE trade = 'Civil'
    UNION ALL SELECT project_id, trade, NULL, NULL, NULL, NULL FROM truth WHERE trade = 'Paint'""",
    ("truth",),
)
def _(t: Tables):
    docs = t.truth_documents.withColumn("truth", fixtures.parse_truth(F.col("text")))
    return fixtures.truth_items(docs).select(
        "project_id", "trade", F.col("item_no").cast("long").alias("item_no"), "amount", "formula", "rate"
    )


@query(
    "s12_sheet_read_back",
    """SELECT project_id, trade, description, quantity, unit, rate, total AS amount FROM bill""",
    ("bill",),
)
def _(t: Tables):
    path = new_path(t.spark, "sheets")
    sheet = export.bill_sheet(t.bill, t.projects, CLOCK)
    export.write_sheets(sheet, path)
    return export.parse_sheets(t.spark.read.schema(sheet.schema).parquet(path))


# ------------------------------------------------------------------ sinks


@query(
    "k01_append",
    "SELECT project_id, CAST(count(*) AS BIGINT) AS drawings FROM drawings GROUP BY 1",
    ("drawings",),
)
def _(t: Tables):
    path = new_path(t.spark, "append")
    rows = t.drawings.select("id", "project_id", "status")
    for part in (F.col("status") == "detected", F.col("status") != "detected"):
        maintenance.append(rows.where(part), path)
    return (
        t.spark.read.schema(rows.schema).parquet(path).groupBy("project_id").agg(F.count("*").alias("drawings"))
    )


ROWS_PER_BUCKET = 1_000  # small, so that test tables have several
_SCOPE_SQL = "SELECT id FROM projects WHERE client = 'MACHINERY'"


@query(
    "k02_replace_scope",
    f"""SELECT project_id, trade, CAST(count(*) AS BIGINT) AS lines, {sum_money_sql('total')} AS total FROM (
      SELECT project_id, trade, total FROM bill WHERE project_id NOT IN ({_SCOPE_SQL})
      UNION ALL SELECT project_id, trade, {money_sql('total * 1.5')} FROM bill
        WHERE project_id IN ({_SCOPE_SQL}) AND trade = 'Civil' AND total > 0)
    GROUP BY 1, 2""",
    ("bill", "projects"),
)
def _(t: Tables):
    scope = t.projects.where(F.col("client") == "MACHINERY").select(F.col("id").alias("project_id"))
    old = t.bill.select("id", "project_id", "trade", "total")
    new = maintenance.in_scope(old, scope, ["project_id"]).where(
        (F.col("trade") == "Civil") & (F.col("total") > 0)
    ).withColumn("total", N.money(F.col("total") * 1.5))
    root = new_path(t.spark, "bill")
    commit = snapshots.begin(t.spark, root)
    commit.create("lines", old, "project_id", rows_per_bucket=ROWS_PER_BUCKET)
    commit.finish()
    commit = snapshots.begin(t.spark, root)
    commit.replace("lines", new, scope)
    commit.finish()
    result = snapshots.read(t.spark, root, "lines")
    return result.groupBy("project_id", "trade").agg(
        F.count("*").alias("lines"), N.sum_money(F.col("total")).alias("total")
    )


_EDITS_SQL = f"""edits AS (SELECT event_id % {LINE_SPAN_SQL} * 3 + 1 AS id, CASE WHEN event_type IN ('view','click') THEN 'quantity'
    WHEN event_type = 'error' THEN 'note' ELSE 'rate' END AS field,
    CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(user_id AS VARCHAR) || '.5 sft' WHEN 2 THEN '-' || user_id
      ELSE ' ' || CAST(user_id * 3 AS VARCHAR) END AS raw,
    CASE event_id % 4 WHEN 1 THEN user_id + 0.5 WHEN 3 THEN user_id * 3.0 WHEN 2 THEN -user_id END AS value, ts, event_id FROM events)"""


def _edits(t: Tables):
    n, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
    raw = (
        F.when(n % 4 == 0, "n/a")
        .when(n % 4 == 1, F.concat(user.cast("string"), F.lit(".5 sft")))
        .when(n % 4 == 2, F.concat(F.lit("-"), user.cast("string")))
        .otherwise(F.concat(F.lit(" "), (user * 3).cast("string")))
    )
    field = F.when(kind.isin("view", "click"), "quantity").when(kind == "error", "note").otherwise("rate")
    return t.events.select(
        (n % t.line_span * 3 + 1).alias("id"), field.alias("field"), raw.alias("raw"), "ts", n.alias("edit_id")
    )


_VALID_SQL = f"""WITH {_EDITS_SQL}, valid AS (SELECT id, field, arg_max(value, (ts, event_id)) AS value FROM edits
    WHERE field IN ('quantity','rate') AND value >= 0 GROUP BY 1, 2),
    wide AS (SELECT id, max(CASE WHEN field='quantity' THEN value END) AS q, max(CASE WHEN field='rate' THEN value END) AS r
      FROM valid GROUP BY 1)"""


@query(
    "chain_write_path",
    f"""WITH scope AS ({_SCOPE_SQL}), new AS (SELECT project_id, {money_sql('total * 1.5')} AS total FROM bill
      WHERE project_id IN (FROM scope) AND trade = 'Civil' AND total > 0),
    lines AS (SELECT project_id, total FROM bill WHERE project_id NOT IN (FROM scope) UNION ALL FROM new)
    SELECT p.id AS project_id, CAST(coalesce(l.n, 0) AS BIGINT) AS lines, coalesce(l.total, 0.0) AS total, v.total AS version_total,
      CASE WHEN p.id IN (FROM scope) THEN {stamp_sql(f"greatest(p.updated_at, make_timestamp({CLOCK_MS} * 1000))")} ELSE {stamp_sql('p.updated_at')} END AS updated_at
    FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, {sum_money_sql('total')} AS total FROM lines GROUP BY 1) l ON l.project_id = p.id
    LEFT JOIN (SELECT project_id, {sum_money_sql('total')} AS total FROM new GROUP BY 1) v ON v.project_id = p.id""",
    ("bill", "projects"),
)
def _(t: Tables):
    """Replace the lines of the projects in scope, touch the projects, append their cost versions: one commit."""
    scope = t.projects.where(F.col("client") == "MACHINERY").select(F.col("id").alias("project_id"))
    old = t.bill.select("id", "project_id", "trade", "total")
    root = new_path(t.spark, "store")
    create_store(t.spark, root, old, t.projects, ROWS_PER_BUCKET)
    bill = snapshots.read(t.spark, root, "lines")
    new = maintenance.in_scope(bill, scope, ["project_id"]).where((F.col("trade") == "Civil") & (F.col("total") > 0))
    replace_lines(t.spark, root, new.withColumn("total", N.money(F.col("total") * 1.5)), scope, CLOCK)
    lines = snapshots.read(t.spark, root, "lines").groupBy("project_id").agg(F.count("*").alias("lines"), N.sum_money(F.col("total")).alias("total"))
    versions = snapshots.read(t.spark, root, "versions").select("project_id", F.col("materials_total").alias("version_total"))
    projects = snapshots.read(t.spark, root, "projects").select(F.col("id").alias("project_id"), stamp("updated_at").alias("updated_at"))
    joined = projects.join(lines, "project_id", "left").join(versions, "project_id", "left")
    return joined.select("project_id", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), F.coalesce("total", F.lit(0.0)).alias("total"), "version_total", "updated_at")


@query(
    "s03_project_read",
    "SELECT id, project_id, trade, total FROM bill WHERE project_id IN (7, 11, 1000000000)",
    ("bill",),
)
def _(t: Tables):
    """The bills of a few projects, from their buckets alone."""
    root = new_path(t.spark, "store")
    commit = snapshots.begin(t.spark, root)
    commit.create("lines", t.bill.select("id", "project_id", "trade", "total"), "project_id", rows_per_bucket=ROWS_PER_BUCKET)
    commit.finish()
    return snapshots.read(t.spark, root, "lines", keys=[7, 11, 1_000_000_000])


@query(
    "p13_valid_edits",
    _VALID_SQL + " SELECT id, field, CAST(value AS DOUBLE) AS value FROM valid",
)
def _(t: Tables):
    return maintenance.valid_edits(_edits(t))


@query(
    "k03_line_edits",
    _VALID_SQL
    + f""" SELECT b.id, coalesce(w.q, quantity) AS quantity, coalesce(w.r, rate) AS rate,
    CASE WHEN w.id IS NULL THEN total ELSE {money_sql('coalesce(w.q, quantity) * coalesce(w.r, rate)')} END AS total, trade
    FROM bill b LEFT JOIN wide w ON b.id = w.id""",
    ("bill",),
)
def _(t: Tables):
    lines = t.bill.select("id", "quantity", "rate", "total", "trade")
    patches = maintenance.edit_patches(lines, _edits(t))
    return maintenance.updated(lines, patches, "id", ["quantity", "rate", "total"])


@query(
    "k04_status_update",
    f"""SELECT d.id, coalesce(u.status, d.status) AS status, {stamp_sql('coalesce(u.at, d.detected_at)')} AS detected_at
    FROM drawings d LEFT JOIN (SELECT drawing_id, arg_max(status, (ts, status)) AS status,
      max(CASE WHEN status = 'processed' THEN ts END) AS at FROM reports GROUP BY 1) u ON u.drawing_id = d.id""",
    ("drawings", "reports"),
)
def _(t: Tables):
    reports = t.reports
    updates = reports.groupBy(F.col("drawing_id").alias("id")).agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"),
        F.max(F.when(F.col("status") == "processed", F.col("ts"))).alias("detected_at"),
    )
    drawings = t.drawings.select("id", "status", "detected_at")
    return maintenance.with_status(drawings, updates).select("id", "status", stamp("detected_at").alias("detected_at"))


_ROLL_SQL = f"""{money_sql('m')} AS materials_total, {money_sql('m * 0.35')} AS labour_total, {money_sql('m * 0.05')} AS transport_total,
    {money_sql('m * 0.08')} AS overheads_total, {money_sql('s')} AS subtotal, {money_sql('s * 0.15')} AS markup_amount,
    {money_sql('s * 0.05')} AS contingency_amount, {money_sql('s + s * 0.15 + s * 0.05')} AS total
    FROM (SELECT project_id, m, m + m * 0.35 + m * 0.05 + m * 0.08 AS s FROM
      (SELECT project_id, {sum_money_sql('total')} AS m FROM {{source}} GROUP BY 1))"""


@query(
    "k05_cost_snapshot",
    f"SELECT project_id, 'v{CLOCK_MS}' AS version_label, " + _ROLL_SQL.format(source="bill"),
    ("bill",),
)
def _(t: Tables):
    path = new_path(t.spark, "versions")
    snapshot = costing.cost_snapshot(boq.trade_summary(t.bill), CLOCK)
    maintenance.append(snapshot, path)
    stored = t.spark.read.schema(snapshot.schema).parquet(path)
    return stored.select(
        "project_id", "version_label", "materials_total", "labour_total", "transport_total", "overheads_total",
        "subtotal", "markup_amount", "contingency_amount", "total",
    )


def _number_sql(x: str) -> str:
    """Text of a non-negative number with at most three decimals."""
    return (
        f"CAST(CAST(floor(floor(({x})*1000.0+0.5)/1000) AS BIGINT) AS VARCHAR) || rtrim(rtrim('.' || "
        f"lpad(CAST(CAST(floor(({x})*1000.0+0.5) AS HUGEINT) % 1000 AS VARCHAR), 3, '0'), '0'), '.')"
    )


def _quoted_sql(x: str) -> str:
    return f"""CASE WHEN contains({x}, ',') OR contains({x}, '"') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


@query(
    "k06_bill_sheet",
    f"""WITH body AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY trade NULLS LAST, id) + 4 AS line_no,
      coalesce(trade, '') || ',' || {_quoted_sql('description')} || ',' || {_number_sql('quantity')} || ',' || unit || ',' ||
      {_number_sql('rate')} || ',' || {_number_sql('total')} AS text, total FROM bill),
    sums AS (SELECT p.id, name, client, count(b.total) AS n, coalesce({sum_money_sql('b.total')}, 0) AS total
      FROM projects p LEFT JOIN bill b ON b.project_id = p.id GROUP BY 1, 2, 3)
    SELECT project_id, CAST(line_no AS BIGINT) AS line_no, text FROM body
    UNION ALL SELECT id, 0, 'Bill of Quantities' FROM sums UNION ALL SELECT id, 1, 'Project,' || name FROM sums
    UNION ALL SELECT id, 2, 'Client,' || coalesce(client, '') FROM sums
    UNION ALL SELECT id, 3, 'Generated,2024-06-01T12:00:00.250Z' FROM sums
    UNION ALL SELECT id, 4, 'Trade,Description,Quantity,Unit,Rate,Amount' FROM sums
    UNION ALL SELECT id, n + 5, ',,,,Grand Total,' || {_number_sql('total')} FROM sums""",
    ("bill", "projects"),
)
def _(t: Tables):
    return export.bill_sheet(t.bill, t.projects, CLOCK, block_width=5_000)


@query(
    "k07_deliverable_log",
    f"""SELECT id, project_id, 'BOQ XLSX' AS title, {stamp_sql('created_at')} AS created_at FROM versions""",
    ("versions",),
)
def _(t: Tables):
    exports = t.versions.select("id", "project_id", F.lit("BOQ XLSX").alias("title"), "created_at")
    path = new_path(t.spark, "exports")
    maintenance.append(exports, path)
    log = maintenance.deliverable_log(t.spark.read.schema(exports.schema).parquet(path))
    return log.withColumn("created_at", stamp("created_at"))


_GONE_SQL = "SELECT id FROM projects WHERE status = 'archived'"


@query(
    "k08_cascade_delete",
    f"""SELECT 'projects' AS tab, id AS project_id, CAST(1 AS BIGINT) AS n FROM projects WHERE id NOT IN ({_GONE_SQL})
    UNION ALL SELECT 'drawings', project_id, count(*) FROM drawings WHERE project_id NOT IN ({_GONE_SQL}) GROUP BY 2
    UNION ALL SELECT 'lines', project_id, count(*) FROM bill WHERE project_id NOT IN ({_GONE_SQL}) GROUP BY 2""",
    ("projects", "drawings", "bill"),
)
def _(t: Tables):
    gone = t.projects.where(F.col("status") == "archived").select(F.col("id").alias("project_id"))
    left = maintenance.delete_projects(gone, t.projects, {"drawings": t.drawings, "lines": t.bill})
    parts = [left["projects"].select(F.lit("projects").alias("tab"), F.col("id").alias("project_id"), F.lit(1).cast("long").alias("n"))]
    for name in ("drawings", "lines"):
        counted = left[name].groupBy("project_id").agg(F.count("*").alias("n"))
        parts.append(counted.select(F.lit(name).alias("tab"), "project_id", "n"))
    return quality.all_of(parts)


@query(
    "k08_set_null",
    """SELECT id, CASE WHEN drawing_id IN (SELECT id FROM drawings WHERE status <> 'uploaded') THEN drawing_id END AS drawing_id,
    total FROM bill""",
    ("bill", "drawings"),
)
def _(t: Tables):
    left = t.drawings.where(F.col("status") != "uploaded")
    return maintenance.unlink_missing(t.bill.select("id", "drawing_id", "total"), left, "drawing_id")


@query(
    "k09_touch_parent",
    f"""SELECT p.id, {stamp_sql('greatest(p.updated_at, c.at)')} AS updated_at FROM projects p
    LEFT JOIN (SELECT user_id, max(ts) AS at FROM events GROUP BY 1) c ON c.user_id = p.id""",
    ("projects",),
)
def _(t: Tables):
    changes = t.events.select(F.col("user_id").alias("project_id"), F.col("ts").alias("changed_at"))
    touched = maintenance.touch_projects(t.projects.select("id", "updated_at"), changes)
    return touched.select("id", stamp("updated_at").alias("updated_at"))


@query(
    "k10_check_report",
    """SELECT project_id, '{"passed":' || CASE WHEN bool_and(ok) THEN 'true' ELSE 'false' END || ',"checks_run":' || count(*) ||
    ',"checks":[' || string_agg('{"name":"' || name || '","passed":' || CASE WHEN ok THEN 'true' ELSE 'false' END || ',"errors":' ||
      CASE WHEN ok THEN 0 ELSE n END || '}', ',' ORDER BY name) || ']}' AS report
    FROM (SELECT project_id, coalesce(trade, 'Misc') AS name, count_if(total <= 0) AS n, count_if(total <= 0) = 0 AS ok FROM bill GROUP BY 1, 2)
    GROUP BY 1""",
    ("bill",),
)
def _(t: Tables):
    checks = t.bill.groupBy("project_id", boq.trade_name().alias("name")).agg(
        F.count_if(F.col("total") <= 0).alias("errors")
    )
    return check_report(checks.withColumn("passed", F.col("errors") == 0), "project_id")


def _workbook(t: Tables):
    return export.workbook(t.lines, t.purchases, t.projects, t.vendors)


@query(
    "k11_sheet_summary",
    f"""SELECT project_id, CAST(count(DISTINCT trade) AS BIGINT) AS trades, CAST(count(*) AS BIGINT) AS lines,
    {sum_money_sql('total')} AS materials_total FROM lines GROUP BY 1""",
    ("lines",),
)
def _(t: Tables):
    return _workbook(t)["summary"].select("project_id", "trades", "lines", "materials_total")


@query(
    "k11_sheet_detailed",
    """SELECT p.name AS project_name, l.drawing_id, l.label || ' — ' || l.material_name AS description, l.quantity, l.unit, l.rate, l.total
    FROM lines l LEFT JOIN projects p ON p.id = l.project_id""",
    ("lines", "projects"),
)
def _(t: Tables):
    path = new_path(t.spark, "workbook")
    sheet = _workbook(t)["detailed"].select(
        "project_name", "drawing_id", "description", "quantity", "unit", "rate", "total"
    )
    export.write_workbook({"detailed": sheet}, path)
    return t.spark.read.schema(sheet.schema).parquet(f"{path}/detailed")


@query(
    "k11_sheet_materials",
    f"""SELECT project_id, coalesce(material_name, '') AS material_name, CAST(count(*) AS BIGINT) AS lines,
    {sum_quantity_sql('quantity')} AS quantity, {sum_money_sql('total')} AS total FROM lines GROUP BY 1, 2""",
    ("lines",),
)
def _(t: Tables):
    return _workbook(t)["materials"].select("project_id", "material_name", "lines", "quantity", "total")


@query(
    "k11_sheet_vendors",
    f"""SELECT p.project_id, p.vendor_name, v.city, CAST(count(*) AS BIGINT) AS lines, {sum_money_sql('p.total')} AS total
    FROM purchases p LEFT JOIN vendors v ON v.name = p.vendor_name GROUP BY 1, 2, 3""",
    ("purchases", "vendors"),
)
def _(t: Tables):
    return _workbook(t)["vendors"].select("project_id", "vendor_name", "city", "lines", "total")


# ------------------------------------------------------------------ projections


@query(
    "p01_normalise_detections",
    _DETECTION_SQL.format(confidence="CAST(greatest(0.0, least(1.0, confidence)) AS DOUBLE)", source="ai").replace(
        "CAST(greatest(0.0, least(1.0, confidence)) AS DOUBLE)",
        "CASE WHEN confidence IS NOT NULL THEN CAST(greatest(0.0, least(1.0, confidence)) AS DOUBLE) END",
    ),
    ("detections",),
)
def _(t: Tables):
    return _flat(ingest.normalised(detections.explode_detections(t.responses)))


@query(
    "p02_normalise_uploads",
    _DETECTION_SQL.format(
        confidence="CASE WHEN confidence IS NULL THEN 0.7::DOUBLE ELSE CAST(greatest(0.0, least(1.0, confidence)) AS DOUBLE) END",
        source="rule",
    ),
    ("detections",),
)
def _(t: Tables):
    found = detections.explode_detections(t.responses, first=200)
    return _flat(ingest.normalised(found, default_confidence=0.7, source="rule", model="inline-fallback"))


_STORED_SQL = """SELECT material_id, object_type, label, CASE WHEN material_id % 2 = 0 THEN x END AS bx,
    CASE WHEN material_id % 3 <> 0 THEN x + 1 END AS jx, CASE WHEN material_id % 3 <> 0 THEN y + 1 END AS jy,
    CASE WHEN material_id % 3 <> 0 THEN 0.125 END AS jw, y AS wm, drawing_id, confidence FROM objects"""


def _stored(t: Tables):
    m = F.col("material_id")
    box = F.struct(
        (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), F.lit(0.125).alias("width"), F.lit(None).cast("double").alias("height")
    )
    return t.objects.select(
        "id", "drawing_id", "object_type", "label", "confidence",
        F.when(m % 2 == 0, F.col("x")).alias("bbox_x"),
        F.lit(None).cast("double").alias("bbox_y"),
        F.lit(None).cast("double").alias("length_mm"),
        F.col("y").alias("width_mm"),
        F.lit(None).cast("double").alias("area_mm2"),
        F.when(m % 3 != 0, box).alias("bbox"),
        F.lit(None).cast("string").alias("trade"),
        F.lit(None).cast("string").alias("detection_source"),
    )


@query(
    "p03_plan_objects",
    f"""SELECT drawing_id, object_type, coalesce(bx, jx, 0) AS bbox_x, coalesce(jy, 0) AS bbox_y, coalesce(jw, 0)::DOUBLE AS length,
    wm AS width, 'ai' AS detection_source FROM ({_STORED_SQL})""",
    ("objects",),
)
def _(t: Tables):
    return ingest.plan_objects(_stored(t)).select(
        "drawing_id", "object_type", F.get("bbox_coords", F.lit(0)).alias("bbox_x"), "bbox_y", "length", "width", "detection_source"
    )


@query(
    "p04_to_millimetres",
    f"""SELECT drawing_id, coalesce(bx, jx, 0) * 15000 AS bbox_x, coalesce(jy, 0) * 10000 AS bbox_y,
    coalesce(jw, 0)::DOUBLE * 15000 AS length, wm * 10000 AS width FROM ({_STORED_SQL})""",
    ("objects",),
)
def _(t: Tables):
    plan = ingest.to_millimetres(ingest.plan_objects(_stored(t)))
    return plan.select("drawing_id", "bbox_x", "bbox_y", "length", "width")


_KINDS = ("Glass Door", "Interior wall", "Office CHAIR", "Window label", "Point of light", "exterior", "text tag", "unknown", None)
_KIND_SQL = pick_sql("event_id % 9", [k for k in _KINDS if k])
_CATEGORY_SQL = pick_sql(
    "event_id % 9", ("door", "partition", "furniture", "window", "electrical", "wall", "text", "other")
).replace(" END", " ELSE 'other' END")


def _kinds(t: Tables):
    kind = F.lit(None).cast("string")
    for i, k in enumerate(_KINDS):
        if k:
            kind = F.when(F.col("event_id") % 9 == i, F.lit(k)).otherwise(kind)
    return t.events.select("event_id", kind.alias("object_type"))


@query(
    "p05_categories",
    f"SELECT event_id, {_CATEGORY_SQL} AS category FROM events",
)
def _(t: Tables):
    return _kinds(t).select("event_id", X.object_category(F.col("object_type")).alias("category"))


_HEIGHTS_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN {h}" for c, _, h in X.CATEGORY_ATTRIBUTES) + " END"


@query(
    "p06_category_attributes",
    f"""SELECT event_id, category, CASE WHEN category = 'other' THEN 'obj-wall' ELSE 'obj-' || category END AS cls,
    CAST({_HEIGHTS_SQL} AS DOUBLE) AS height3d FROM (SELECT event_id, {_CATEGORY_SQL} AS category FROM events)""",
)
def _(t: Tables):
    return ingest.with_attributes(_kinds(t), X.CATEGORY_ATTRIBUTES).drop("object_type")


@query(
    "p07_quantities",
    f"""SELECT drawing_id, object_type, CASE WHEN per_area = 1 THEN {half_up_sql('CASE WHEN quantity_estimate > 0 THEN quantity_estimate ELSE 1.0 END')}
    ELSE 1 END AS quantity FROM objects JOIN rules USING (object_type)""",
    ("objects", "rules"),
)
def _(t: Tables):
    rules = BOUND_RULES.rules_table(t.spark).select("object_type", "per_area")
    quantity = line_quantity(F.col("per_area"), F.col("quantity_estimate"))
    return t.objects.join(rules, "object_type").select("drawing_id", "object_type", quantity.alias("quantity"))


@query(
    "p08_money_rounding",
    f"""SELECT l_orderkey, l_linenumber, {money_sql('l_extendedprice * l_discount')} AS rebate,
    {money_sql('-l_extendedprice / 7.0')} AS negative FROM lineitem""",
)
def _(t: Tables):
    price = F.col("l_extendedprice")
    return t.raw("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"),
        N.money(price * F.col("l_discount")).alias("rebate"), N.money(-price / 7.0).alias("negative"),
    )


@query(
    "p09_descriptions",
    "SELECT drawing_id, label || ' — ' || material_name AS description FROM lines",
    ("lines",),
)
def _(t: Tables):
    return t.lines.select("drawing_id", "description")


@query("p10_lump_sums", "SELECT id, unit, total FROM bill", ("bill",))
def _(t: Tables):
    return t.bill.select("id", "unit", boq.lump_sum_total(F.col("quantity"), F.col("unit"), F.col("rate")).alias("total"))


@query(
    "p11_tax_included",
    "SELECT id, rate * (1.0 + gst_rate / 100.0) AS total FROM materials",
    ("materials",),
)
def _(t: Tables):
    return t.materials.select("id", materials.tax_included(F.col("rate"), F.col("gst_rate")).alias("total"))


@query("p12_material_names", "SELECT id, trim(brand || ' ' || name) AS material_name FROM materials", ("materials",))
def _(t: Tables):
    return t.materials.select("id", X.brand_and_name(F.col("brand"), F.col("name")).alias("material_name"))


@query(
    "p14_bill_defaults",
    "SELECT id, quantity, coalesce(unit, '') AS unit, rate, total, trade, material_name FROM bill",
    ("bill",),
)
def _(t: Tables):
    return boq.bill_lines(t.bill).select("id", "quantity", "unit", "rate", "total", "trade", "material_name")


_MILLI = "CAST(floor(abs(balance)*1000.0+0.5) AS BIGINT)"
_WHOLE = f"CAST({_MILLI} // 1000 AS VARCHAR)"


@query(
    "p15_indian_digits",
    f"""SELECT id, CASE WHEN balance < 0 THEN '-' ELSE '' END || {indian_sql(_WHOLE)} ||
      rtrim(rtrim('.' || lpad(CAST({_MILLI} % 1000 AS VARCHAR), 3, '0'), '0'), '.') AS shown,
    CASE WHEN floor(balance + 0.5) < 0 THEN '-' ELSE '' END ||
      {indian_sql('CAST(CAST(abs(floor(balance + 0.5)) AS BIGINT) AS VARCHAR)')} AS rounded
    FROM (SELECT id, balance * 1000.37 AS balance FROM projects)""",
    ("projects",),
)
def _(t: Tables):
    amount = F.col("balance") * 1000.37
    return t.projects.select(
        "id", N.indian_digits(amount).alias("shown"), N.indian_digits(amount, rounded=True).alias("rounded")
    )


@query(
    "p16_padded_ids",
    "SELECT id, CASE WHEN length(CAST(id AS VARCHAR)) < 3 THEN lpad(CAST(id AS VARCHAR), 3, '0') ELSE CAST(id AS VARCHAR) END AS shown FROM projects",
    ("projects",),
)
def _(t: Tables):
    return t.projects.select("id", X.pad_id(F.col("id")).alias("shown"))


@query(
    "p17_display_dates",
    "SELECT event_id, strftime(ts, '%d %b %Y') AS day, strftime(ts, '%d %b, %H:%M') AS moment FROM events",
)
def _(t: Tables):
    return t.events.select(
        "event_id", X.display_date(F.col("ts")).alias("day"), X.display_datetime(F.col("ts")).alias("moment")
    )


@query(
    "p18_file_names",
    r"""SELECT id, regexp_replace(name, '\.[^.]+$', '') AS stem, lower(name) LIKE '%.pdf' AS pdf,
    substr(name, 1, 10) AS short_name, CASE id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN repeat('image/png;', 5)
    ELSE 'application/pdf' END AS content_type FROM drawings""",
    ("drawings",),
)
def _(t: Tables):
    given = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.repeat(F.lit("image/png;"), 7))
    return t.drawings.select(
        "id",
        X.file_stem(F.col("name")).alias("stem"),
        X.is_pdf(F.col("name"), F.lit(None).cast("string")).alias("pdf"),
        F.substring("name", 1, 10).alias("short_name"),
        X.content_type_or_default(given).alias("content_type"),
    )


@query(
    "p19_storage_paths",
    """SELECT id, project_id || '/' || epoch_ms(created_at) || '-' || name AS path,
    'https://files.example/drawings/' || replace(replace(project_id || '/' || epoch_ms(created_at) || '-' || name, '+', '%2B'), ' ', '%20') AS url
    FROM drawings""",
    ("drawings",),
)
def _(t: Tables):
    path = U.storage_path(F.col("project_id"), F.col("created_at"), F.col("name"))
    return t.drawings.select("id", path.alias("path"), U.object_url("https://files.example/drawings", path).alias("url"))


@query(
    "p20_url_parameters",
    r"""SELECT page_id, CASE WHEN try_cast(page AS DOUBLE) > 0 THEN try_cast(page AS DOUBLE) ELSE 1 END AS page,
    try_cast(nullif(regexp_extract(url, '^https?://[^/?#]+/[a-z]+/(\d+)(?:[?#].*)?$', 1), '') AS BIGINT) AS path_number
    FROM (SELECT page_id, url, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages)""",
)
def _(t: Tables):
    return t.raw("pages").select(
        "page_id",
        U.positive_parameter(F.col("url"), "page").alias("page"),
        U.path_id(F.try_parse_url("url", F.lit("PATH")), "/[a-z]+").alias("path_number"),
    )


@query("p21_version_labels", "SELECT id, version_label FROM versions", ("versions",))
def _(t: Tables):
    return t.versions.select("id", U.version_label(F.col("created_at")).alias("version_label"))


@query(
    "p22_status_labels",
    """SELECT id, CASE status WHEN 'draft' THEN 'Draft' WHEN 'in_progress' THEN 'In progress' WHEN 'priced' THEN 'Priced'
    WHEN 'sent' THEN 'Sent' ELSE 'Archived' END AS label FROM projects""",
    ("projects",),
)
def _(t: Tables):
    return t.projects.select("id", X.status_label(F.col("status")).alias("label"))


@query(
    "p23_material_families",
    """SELECT o_orderkey, CASE WHEN lower(k) SIMILAR TO '.*(tile|floor).*' THEN 'tile' WHEN contains(lower(k), 'glass') THEN 'glass'
    WHEN lower(k) SIMILAR TO '.*(wall|paint).*' THEN 'wall' WHEN contains(lower(k), 'carpet') THEN 'carpet'
    WHEN lower(k) SIMILAR TO '.*(light|electric).*' THEN 'light' ELSE 'other' END AS family FROM (SELECT o_orderkey,
    """
    + pick_sql("o_orderkey % 7", ("Glass tile", "Wall GLASS", "Painted wall", "Carpet", "Electrical", "Blinds", "Floor light"))
    + " AS k FROM orders)",
)
def _(t: Tables):
    kinds = ("Glass tile", "Wall GLASS", "Painted wall", "Carpet", "Electrical", "Blinds", "Floor light")
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 7).cast("int"))
    return t.raw("orders").select("o_orderkey", X.material_family(kind).alias("family"))


@query(
    "p24_breakdown_json",
    f"""SELECT project_id, '[' || string_agg('{{"trade":"' || trade || '","count":' || n || '}}', ',' ORDER BY total DESC, trade) || ']' AS breakdown
    FROM (SELECT project_id, coalesce(trade, 'Misc') AS trade, count(*) AS n, {sum_money_sql('total')} AS total FROM bill GROUP BY 1, 2)
    GROUP BY 1""",
    ("bill",),
)
def _(t: Tables):
    listed = costing.breakdown(boq.trade_summary(t.bill))
    # numbers are spelled differently by the engines, so the totals are left out of the compared text
    return listed.select(
        "project_id", F.regexp_replace("breakdown", r'"total":[^,]*,', "").alias("breakdown")
    )


@query(
    "p25_seed_quantities",
    f"""SELECT drawing_id, object_type, greatest(1, {half_up_sql('x * y * 100')}) AS quantity,
    CASE WHEN object_type IN ('LARGE','SMALL') THEN 'nos' ELSE 'sqft' END AS unit FROM objects""",
    ("objects",),
)
def _(t: Tables):
    return t.objects.select(
        "drawing_id",
        "object_type",
        ingest.seed_quantity(F.col("x"), F.col("y")).alias("quantity"),
        ingest.seed_unit(F.col("object_type"), ("LARGE", "SMALL")).alias("unit"),
    )


@query(
    "p27_room_areas",
    """SELECT file, CAST(count(*) AS BIGINT) AS rooms, sum(area) AS area FROM (SELECT CAST(o_custkey AS VARCHAR) AS file,
    (o_orderkey % 20 + 1.5) * (o_orderkey % 9 + 2) AS area FROM orders WHERE o_orderkey % 4 = 3) GROUP BY 1""".replace(
        "sum(area)", "CAST(sum(area) AS DOUBLE)"
    ),
)
def _(t: Tables):
    texts = cad.entities(t.cad_lines).where(F.col("entity") == "TEXT")
    rooms = texts.select("file", X.room_area_sqft(F.col("text")).alias("area"))
    return rooms.groupBy("file").agg(F.count("area").alias("rooms"), N.sum_quantity(F.col("area")).alias("area"))


# ------------------------------------------------------------------ filters


@query(
    "f01_optional_filters",
    "SELECT id, name FROM drawings WHERE status = 'detected'",
    ("drawings",),
)
def _(t: Tables):
    return boq.scoped(t.drawings, status="detected", project_id=None).select("id", "name")


@query(
    "f02_catalogue_search",
    """SELECT id, name, brand, rate FROM materials WHERE category = 'Gypsum' AND contains(lower(name), 'gear')
    ORDER BY name, id LIMIT 200""",
    ("materials",),
)
def _(t: Tables):
    return materials.search(t.materials, "GEAR", "Gypsum", 200).select("id", "name", "brand", "rate")


@query(
    "f03_any_column_search",
    """SELECT id, name, brand, category FROM materials WHERE contains(lower(name), 'la') OR contains(lower(brand), 'la')
    OR contains(lower(category), 'la')""",
    ("materials",),
)
def _(t: Tables):
    return materials.matching_any(t.materials, "La").select("id", "name", "brand", "category")


@query(
    "f04_trade_groups",
    f"""SELECT project_id, trade, {sum_money_sql('total')} AS total, CAST(count(*) AS BIGINT) AS count FROM lines
    WHERE contains(lower(trade), 'al') GROUP BY 1, 2""",
    ("lines",),
)
def _(t: Tables):
    return boq.trade_groups(t.lines, "AL")


@query(
    "f05_drop_without_rule",
    "SELECT project_id, CAST(count(*) AS BIGINT) AS lines FROM objects WHERE object_type <> 'SMALL' GROUP BY 1",
    ("objects",),
)
def _(t: Tables):
    lines = expand_lines(
        t.objects, BOUND_RULES.rules_table(t.spark), BOUND_RULES.overrides_table(t.spark), BOUND_RULES.override_type
    )
    return lines.groupBy("project_id").agg(F.count("*").alias("lines"))


@query(
    "f06_real_items",
    "SELECT project_id, trade, amount FROM truth WHERE amount > 0",
    ("truth",),
)
def _(t: Tables):
    docs = t.truth_documents.withColumn("truth", fixtures.parse_truth(F.col("text")))
    return real_items(fixtures.truth_items(docs)).select("project_id", "trade", "amount")


@query("f07_active_materials", "SELECT id, name FROM materials WHERE active", ("materials",))
def _(t: Tables):
    return t.materials.where(F.col("active")).select("id", "name")


@query(
    "f08_enum_violations",
    """SELECT CAST(l_orderkey AS VARCHAR) AS key, rule, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT l_orderkey, 'confidence outside 0 to 1' AS rule FROM lineitem WHERE (l_discount + 0.0) * 20.0 - 0.5 NOT BETWEEN 0 AND 1
      UNION ALL SELECT l_orderkey, 'source unknown' FROM lineitem WHERE l_returnflag <> 'A' AND l_returnflag <> 'N') GROUP BY 1, 2""",
)
def _(t: Tables):
    rows = t.raw("lineitem").select(
        "l_orderkey",
        ((F.col("l_discount") + 0.0) * 20.0 - 0.5).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "ai").when(F.col("l_returnflag") == "N", "rule").otherwise("none").alias("source"),
    )
    broken = quality.violations(
        rows,
        "l_orderkey",
        {
            "confidence outside 0 to 1": ~F.col("confidence").between(0, 1),
            "source unknown": quality.outside("source", ("rule", "ai", "hybrid")),
        },
    )
    return broken.groupBy("key", "rule").agg(F.count("*").alias("n"))


@query(
    "f08_state_violations",
    """SELECT key, rule, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CAST(c_custkey AS VARCHAR) AS key, 'project status' AS rule FROM customer WHERE c_custkey % 7 = 0
      UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'drawing status' FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'detection source' FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'confidence' FROM lineitem WHERE (l_discount + 0.0) * 20.0 - 0.5 NOT BETWEEN 0 AND 1) GROUP BY 1, 2""",
)
def _(t: Tables):
    projects = t.projects.withColumn("status", F.when(F.col("id") % 7 == 0, "closed").otherwise(F.col("status")))
    drawings = t.drawings.withColumn("status", F.when(F.col("status") == "processing", "lost").otherwise(F.col("status")))
    flag = F.col("l_returnflag")
    objects = t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"),
        ((F.col("l_discount") + 0.0) * 20.0 - 0.5).alias("confidence"),
        F.when(flag == "A", "ai").when(flag == "N", "rule").otherwise("none").alias("detection_source"),
    )
    return quality.state_violations(projects, drawings, objects).groupBy("key", "rule").agg(F.count("*").alias("n"))


@query(
    "f09_master_data",
    """SELECT sku AS key, 'sku not unique' AS rule FROM materials GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT CAST(id AS VARCHAR), 'rate not positive' FROM materials WHERE rate <= 0
    UNION ALL SELECT DISTINCT vendor_name, 'vendor unknown' FROM materials WHERE vendor_name NOT IN (SELECT name FROM vendors)
    UNION ALL SELECT name, 'vendor not unique' FROM vendors GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT CAST(id AS VARCHAR), 'tax number malformed' FROM vendors WHERE gst <> upper(gst)
    UNION ALL SELECT material_name, 'wastage outside 0 to 100' FROM wastage WHERE wastage_pct > 100
    UNION ALL SELECT trade, 'productivity not positive' FROM labour WHERE productivity <= 0""",
    ("materials", "vendors", "wastage", "labour"),
)
def _(t: Tables):
    return quality.master_data_violations(t.materials, t.vendors, t.wastage(), t.labour())


@query(
    "f10_upload_checks",
    """SELECT path, rule FROM (SELECT 'up/' || d.id || CASE d.id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.dxf' WHEN 2 THEN '.PDF' ELSE '' END AS path,
      d.id, file_size FROM drawings d) f, LATERAL (
        SELECT 'type not allowed' AS rule WHERE f.id % 4 = 3 UNION ALL SELECT 'file too large' WHERE file_size > 52428800
        UNION ALL SELECT 'request too large' WHERE file_size > 10485760
        UNION ALL SELECT 'content does not fit type' WHERE f.id % 4 IN (0, 2) AND f.id % 3 <> 0)""",
    ("drawings",),
)
def _(t: Tables):
    key = F.col("id")
    manifest = t.drawings.select(
        F.concat(
            F.lit("up/"), key.cast("string"),
            F.when(key % 4 == 0, ".pdf").when(key % 4 == 1, ".dxf").when(key % 4 == 2, ".PDF").otherwise(""),
        ).alias("path"),
        F.col("file_size").alias("length"),
        F.when(key % 3 == 0, "25504446").otherwise("00000000").alias("head"),
    )
    return quality.upload_problems(manifest).withColumnRenamed("key", "path")


@query(
    "f11_run_log",
    """SELECT CAST(event_id AS VARCHAR) AS key, 'source not accepted' AS rule FROM events WHERE event_type <> 'view'
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'no calls made' FROM events WHERE CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) = 0""",
)
def _(t: Tables):
    runs = t.events.select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("event_type") == "view", "pdf").otherwise("mock").alias("source"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("calls"),
    )
    return quality.run_log_problems(runs)
