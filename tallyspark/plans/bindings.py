"""Domain tables derived from the given test tables, once for Spark and once as SQL.

`Tables` builds the DataFrames; `VIEWS` holds the same tables as SQL for the
checks. Every view grows with the given tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema as S
from tallyspark.functions.numbers import half_up, money
from tallyspark.operators.boq import lump_sum_total
from tallyspark.operators.expand import expand_with
from tallyspark.rules import RuleSet, literal_table

# Rules of the test binding: five of the six part types, one left without a rule.
RULES = (
    ("STANDARD", "Civil", "sft", 85.0, "Brick masonry", 1),
    ("ECONOMY", "Gypsum", "sft", 200.5, "Gypsum board 75mm", 1),
    ("LARGE", "Carpentry", "nos", 27000.0, "Rod and rail set", 0),
    ("MEDIUM", "Modular Furniture", "nos", 23000.0, "Widget workstation", 0),
    ("PROMO", "Electrical", "points", 2250.25, "Bolt-on wiring", 0),
)
# Overrides of the test binding; two of them can match one label.
OVERRIDES = (
    (1, "hot gear", "Plumbing", "nos", 85000.0, "Gear pump", 0),
    (2, "gear", "Carpentry", "nos", 45000.0, "Gear shelving", 0),
    (3, "hot", "HVAC", "nos", 180000.0, "Hot air unit", 0),
    (4, "ring", "Modular Furniture", "sft", 120.0, "Ring acoustic pod", 1),
    (5, "red r", "Painting", "sft", 31.35, "Red lustre paint", 1),
)
BOUND_RULES = RuleSet(RULES, OVERRIDES, "STANDARD", "test_v1")

# Labour per trade: rate, unit, daily productivity (none where 0).
LABOUR = (
    ("Civil", 40.0, "sft", 120.0),
    ("Gypsum", 55.5, "sft", 80.0),
    ("Carpentry", 900.0, "nos", 4.0),
    ("Electrical", 350.25, "points", 0.0),
    ("Plumbing", 1200.0, "nos", 2.0),
)
WASTAGE = (
    ("Brick masonry", 5.0),
    ("Gypsum board 75mm", 7.5),
    ("Red lustre paint", 12.0),
    ("Bolt-on wiring", 105.0),
)
# Words material names of bill lines start with.
BILL_MATERIALS = ("Gear housing", "Ring seal", "Widget frame", "Small fixings", "Hot water line")


def _pick(index, values):
    column = F.lit(None).cast("string")
    for i, value in enumerate(values):
        column = F.when(index == i, F.lit(value)).otherwise(column)
    return column


LINE_SPAN_SQL = "(SELECT max(o_orderkey) // 3 + 1 FROM orders)"


class Tables:
    """Lazily read domain tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def projects(self) -> DataFrame:
        minute = F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 60)
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("client"),
            _pick(F.col("c_nationkey") % 5, S.PROJECT_STATUSES).alias("status"),
            F.col("c_acctbal").alias("balance"),
            minute.alias("created_at"),
            minute.alias("updated_at"),
        )

    @property
    def drawings(self) -> DataFrame:
        key = F.col("o_orderkey")
        suffix = _pick(key % 4, (".pdf", ".dxf", ".PDF", ""))
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("project_id"),
            F.concat(F.lit("plan v1."), key.cast("string"), F.lit(" (a+b)"), suffix).alias("name"),
            half_up(F.col("o_totalprice") * 200).alias("file_size"),
            F.when(F.col("o_orderstatus") == "O", "uploaded")
            .when(F.col("o_orderstatus") == "P", "processing")
            .otherwise("detected")
            .alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("detected_at"),
        )

    @property
    def objects(self) -> DataFrame:
        items = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
        )
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        parts = self.raw("part").select("p_partkey", "p_type", "p_name")
        return self.as_objects(
            items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
                parts, F.col("l_partkey") == F.col("p_partkey")
            )
        )

    @staticmethod
    def as_objects(joined: DataFrame) -> DataFrame:
        return joined.select(
            F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("id"),
            F.col("o_custkey").alias("project_id"),
            F.col("l_orderkey").alias("drawing_id"),
            F.col("p_type").alias("object_type"),
            F.col("p_name").alias("label"),
            (F.col("l_quantity") / 4.0 - 1.0).alias("quantity_estimate"),
            ((F.col("l_discount") + 0.0) * 20.0 - 0.5).alias("confidence"),
            (F.col("l_linenumber") / 8.0).alias("x"),
            (F.col("l_quantity") / 64.0).alias("y"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("material_id"),
        )

    @property
    def lines(self) -> DataFrame:
        return expand_with(self.objects, BOUND_RULES)

    @property
    def bill(self) -> DataFrame:
        """One priced line per order; its id is unique."""
        key = F.col("o_orderkey")
        unit = _pick(key % 4, ("sft", "nos", "LS", "ls"))
        quantity = (key % 40).cast("double")
        price = F.col("o_totalprice")
        trade = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "Civil")
            .when(F.col("o_orderpriority") == "2-HIGH", "Electrical")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Gypsum")
            .when(F.col("o_orderpriority") == "5-LOW", "Modular Furniture")
        )
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("project_id"),
            key.alias("drawing_id"),
            F.concat(F.lit("Item "), key.cast("string"), F.when(key % 3 == 0, F.lit(', "as built"')).otherwise("")).alias(
                "description"
            ),
            trade.alias("trade"),
            F.lit(None).cast("long").alias("material_id"),
            _pick(key % 6, BILL_MATERIALS).alias("material_name"),
            quantity.alias("quantity"),
            unit.alias("unit"),
            price.alias("rate"),
            lump_sum_total(quantity, unit, price).alias("total"),
            (key % 37).alias("rule_id"),
            F.lit(None).cast("string").alias("location"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @property
    def materials(self) -> DataFrame:
        category = F.lit("Glass")
        for kind, trade, *_ in RULES:
            category = F.when(F.col("p_type") == kind, F.lit(trade)).otherwise(category)
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.concat_ws("-", "p_brand", F.col("p_size").cast("string"), "p_type").alias("sku"),
            category.alias("category"),
            F.lit("nos").alias("unit"),
            F.col("p_retailprice").alias("rate"),
            F.when(F.col("p_size") % 3 == 0, 5.0).when(F.col("p_size") % 3 == 1, 12.0).otherwise(18.0).alias("gst_rate"),
            F.format_string("Supplier#%09d", F.floor(F.col("p_partkey") / 15)).alias("vendor_name"),
            (F.col("p_size") % 4 == 0).alias("is_preferred"),
            (F.col("p_size") % 10 != 0).alias("active"),
        )

    @property
    def vendors(self) -> DataFrame:
        tax = F.format_string(
            "%02dABCDE%04dF1Z%d", F.col("s_nationkey"), F.col("s_suppkey") % 10000, F.col("s_suppkey") % 10
        )
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("string").alias("city"),
            F.when(F.col("s_nationkey") % 7 == 0, F.lower(tax)).otherwise(tax).alias("gst"),
        )

    @property
    def purchases(self) -> DataFrame:
        """Lines bought from the supplier of the item, at the price of the material."""
        materials = self.materials.select(F.col("id").alias("material_id"), F.col("rate").alias("price"))
        vendors = self.vendors.select(F.col("id").alias("supplier_id"), F.col("name").alias("vendor_name"))
        quantity = F.when(F.col("quantity_estimate") > 0, F.col("quantity_estimate")).otherwise(F.lit(1.0))
        return (
            self.objects.join(materials, "material_id")
            .join(vendors, "supplier_id")
            .select(
                "project_id", "vendor_name", "material_id", quantity.alias("quantity"), money(quantity * F.col("price")).alias("total")
            )
        )

    @property
    def versions(self) -> DataFrame:
        at = F.col("o_orderdate").cast("timestamp")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("project_id"),
            F.concat(F.lit("v"), F.unix_millis(at).cast("string")).alias("version_label"),
            F.col("o_totalprice").alias("total"),
            at.alias("created_at"),
        )

    @property
    def rates(self) -> DataFrame:
        month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("material_id"), month.alias("valid_from"))
            .agg(F.min(money(F.col("l_extendedprice") / F.col("l_quantity"))).alias("rate"))
        )

    @property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def line_span(self) -> int:
        """A third of the greatest line id, so that the lines that events touch grow with the bill."""
        return (self.raw("orders").agg(F.max("o_orderkey")).first()[0] or 0) // 3 + 1

    def as_changes(self, events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        k = F.regexp_extract("props", r"(\d+)", 1)
        return events.select(
            (F.col("event_id") % self.line_span * 3).alias("boq_item_id"),
            F.when(kind.isin("purchase", "view"), F.col("value") * 100.0).alias("total"),
            F.when(kind.isin("purchase", "click"), F.col("value")).alias("rate"),
            F.when(kind == "signup", F.concat(F.lit("Material "), k)).alias("material_name"),
            F.col("ts").cast("timestamp").alias("ts"),
            "event_id",
        )

    @property
    def changes(self) -> DataFrame:
        return self.as_changes(self.raw("events"))

    @staticmethod
    def as_log(events: DataFrame) -> DataFrame:
        return events.select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("key"),
            F.col("event_type").alias("route"),
            (F.col("event_type") == "error").alias("failed"),
            (F.col("value") / 25.0).alias("latency"),
            "event_id",
        )

    @property
    def log(self) -> DataFrame:
        return self.as_log(self.raw("events"))

    @staticmethod
    def as_reports(events: DataFrame) -> DataFrame:
        """Status reports of drawings, four for each."""
        kind = F.col("event_type")
        status = (
            F.when(kind == "signup", "uploaded")
            .when(kind == "click", "pending")
            .when(kind == "view", "processing")
            .when(kind == "purchase", "processed")
            .otherwise("error")
        )
        return events.select(
            F.floor(F.col("event_id") / 4).cast("long").alias("drawing_id"),
            status.alias("status"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @property
    def reports(self) -> DataFrame:
        return self.as_reports(self.raw("events"))

    @property
    def responses(self) -> DataFrame:
        """Model responses in five forms around the values of an event."""
        n = F.col("event_id")
        body = F.concat(
            F.lit('[{"object_type":"'),
            "event_type",
            F.lit('","label":"L'),
            F.col("user_id").cast("string"),
            F.lit('","bbox":{"x":0.25,"y":0.5,"w":0.125,"height":0.75},"confidence":'),
            F.col("user_id").cast("string"),
            F.lit('e-2,"quantity_estimate":'),
            F.regexp_extract("props", r"(\d+)", 1),
            F.lit(',"unit":"nos"},{"confidence":"0.9","trade":"Civil"},{"object_type":"door","confidence":-1}]'),
        )
        text = (
            F.when(n % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone [1].")))
            .when(n % 5 == 1, F.concat(F.lit('{"objects": '), body, F.lit("}")))
            .when(n % 5 == 2, F.concat(F.lit("Broken: "), F.replace(body, F.lit('"},'), F.lit(","))))
            .when(n % 5 == 3, F.lit("I could not read the plan."))
            .otherwise(F.concat(body, F.lit(" as asked")))
        )
        # some of the calls without an answer did not get through at all
        return self.raw("events").select(
            F.col("user_id").alias("project_id"), n.alias("drawing_id"), text.alias("response"), (n % 10 == 3).alias("failed")
        )

    @property
    def uploads(self) -> DataFrame:
        return self.raw("documents").select(
            F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
            F.octet_length("text").cast("long").alias("length"),
            F.encode("text", "utf-8").alias("content"),
        )

    @property
    def cad_lines(self) -> DataFrame:
        """Numbered lines of CAD files: one file per project, one entity per order."""
        key = F.col("o_orderkey")
        kind = _pick(key % 4, ("LINE", "ARC", "INSERT", "TEXT"))
        layer = _pick(key % 3, ("A-WALL", "A-DOOR", "A-ANNO-TEXT"))
        text = F.concat((key % 20 + 1).cast("string"), F.lit("'-6\" x "), (key % 9 + 2).cast("string"), F.lit("'-0\""))
        pairs = F.array(
            *[
                F.struct(F.lit(code).alias("code"), value.alias("value"))
                for code, value in (
                    ("  0", kind),
                    ("  8", layer),
                    (" 10", (key % 1000).cast("string")),
                    (" 20", F.concat((key % 77).cast("string"), F.lit(".5"))),
                    ("  1", F.when(key % 4 == 3, text).otherwise("")),
                )
            ]
        )
        rows = self.raw("orders").select(
            F.col("o_custkey").cast("string").alias("file"), key.alias("key"), F.posexplode(pairs).alias("pos", "p")
        )
        return rows.select(
            "file",
            F.posexplode(F.array("p.code", "p.value")).alias("side", "line"),
            ((F.col("key") * 5 + F.col("pos")) * 2).alias("_base"),
        ).select("file", (F.col("_base") + F.col("side")).alias("line_no"), "line")

    @property
    def truth_documents(self) -> DataFrame:
        """Nested bills as JSON text, one per order."""
        key, amount = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
        computed = (
            F.when(key % 3 == 0, F.lit(""))
            .when(key % 7 == 0, F.lit('"computed_total":null,'))
            .when(key % 5 == 0, F.lit('"computed_total":0,'))
            .otherwise(F.concat(F.lit('"computed_total":'), amount, F.lit(",")))
        )
        text = F.concat(
            F.lit('{"trades":[{"trade":"Civil",'),
            computed,
            F.lit('"expected_total":'),
            F.floor(F.col("o_totalprice") + 10).cast("string"),
            F.lit(',"items":[{"description":"Description","amount":0},{"description":"Wall","amount":'),
            amount,
            F.lit(',"formula":"a * 2","rate":3}]},{"trade":"Paint","expected_total":100}]}'),
        )
        return self.raw("orders").select(key.alias("project_id"), text.alias("text"))

    def labour(self) -> DataFrame:
        return literal_table(self.spark, LABOUR, "trade string, rate double, unit string, productivity double")

    def wastage(self) -> DataFrame:
        return literal_table(self.spark, WASTAGE, "material_name string, wastage_pct double")


# ---------------------------------------------------------------- the same in SQL


def money_sql(x: str) -> str:
    return f"(floor(({x})*100.0+0.5)/100.0)"


def half_up_sql(x: str) -> str:
    return f"CAST(floor(({x})+0.5) AS BIGINT)"


def sum_money_sql(x: str) -> str:
    return f"(CAST(sum(CAST(floor(({x})*100.0+0.5) AS BIGINT)) AS DOUBLE)/100.0)"


def sum_quantity_sql(x: str) -> str:
    return f"(CAST(sum(CAST(floor(({x})*1000000.0+0.5) AS HUGEINT)) AS DOUBLE)/1000000.0)"


def _value(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({v!r} AS {'DOUBLE' if isinstance(v, float) else 'INTEGER'})"


def values_sql(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def pick_sql(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {_value(v)}" for i, v in enumerate(values)) + " END"


_QTY = "CASE WHEN quantity_estimate > 0 THEN quantity_estimate ELSE 1.0 END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "rules": ((), values_sql(RULES, "object_type, trade, unit, rate, material, per_area")),
    "overrides": ((), values_sql(OVERRIDES, "priority, key, trade, unit, rate, material, per_area")),
    "labour": ((), values_sql(LABOUR, "trade, rate, unit, productivity")),
    "wastage": ((), values_sql(WASTAGE, "material_name, wastage_pct")),
    "projects": (
        (),
        f"""SELECT c_custkey AS id, c_name AS name,
        CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS client,
        {pick_sql('c_nationkey % 5', S.PROJECT_STATUSES)} AS status, c_acctbal AS balance,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS created_at,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS updated_at FROM customer""",
    ),
    "drawings": (
        (),
        f"""SELECT o_orderkey AS id, o_custkey AS project_id,
        'plan v1.' || o_orderkey || ' (a+b)' || {pick_sql('o_orderkey % 4', ('.pdf', '.dxf', '.PDF', ''))} AS name,
        {half_up_sql('o_totalprice * 200')} AS file_size,
        CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'processing' ELSE 'detected' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS detected_at FROM orders""",
    ),
    "objects": (
        (),
        """SELECT o_custkey AS project_id, l_orderkey AS drawing_id, p_type AS object_type, p_name AS label,
        l_quantity / 4.0 - 1.0 AS quantity_estimate, (l_discount + 0.0) * 20.0 - 0.5 AS confidence,
        l_linenumber / 8.0 AS x, l_quantity / 64.0 AS y, l_suppkey AS supplier_id, l_partkey AS material_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    ),
    "lines": (
        ("objects", "rules", "overrides"),
        f"""SELECT project_id, drawing_id, object_type, label, trade, unit, rate, material AS material_name, quantity,
        {money_sql('quantity * rate')} AS total FROM (
          SELECT ob.*, coalesce(ov.trade, r.trade) AS trade, coalesce(ov.unit, r.unit) AS unit,
            coalesce(ov.rate, r.rate) AS rate, coalesce(ov.material, r.material) AS material,
            CASE WHEN coalesce(ov.per_area, r.per_area) = 1 THEN {half_up_sql(_QTY)} ELSE CAST(1 AS BIGINT) END AS quantity
          FROM objects ob JOIN rules r USING (object_type)
          LEFT JOIN (SELECT label AS olabel, min(priority) AS best FROM (SELECT DISTINCT label FROM objects)
                     JOIN overrides ON contains(lower(label), key) GROUP BY label) b
            ON ob.object_type = 'STANDARD' AND b.olabel = ob.label
          LEFT JOIN overrides ov ON ov.priority = b.best)""",
    ),
    "bill": (
        (),
        f"""SELECT id, project_id, id AS drawing_id, description, trade, material_name, quantity, unit, rate, rule_id, created_at,
        CASE WHEN upper(unit) = 'LS' THEN rate ELSE {money_sql('quantity * rate')} END AS total FROM (
          SELECT o_orderkey AS id, o_custkey AS project_id,
            'Item ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ', "as built"' ELSE '' END AS description,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'Civil' WHEN '2-HIGH' THEN 'Electrical'
              WHEN '4-NOT SPECIFIED' THEN 'Gypsum' WHEN '5-LOW' THEN 'Modular Furniture' END AS trade,
            {pick_sql('o_orderkey % 6', BILL_MATERIALS)} AS material_name,
            CAST(o_orderkey % 40 AS DOUBLE) AS quantity, {pick_sql('o_orderkey % 4', ('sft', 'nos', 'LS', 'ls'))} AS unit,
            o_totalprice AS rate, o_orderkey % 37 AS rule_id, o_orderdate AS created_at FROM orders)""",
    ),
    "materials": (
        (),
        "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_brand || '-' || p_size || '-' || p_type AS sku, CASE p_type "
        + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t, *_ in RULES)
        + """ ELSE 'Glass' END AS category, p_retailprice AS rate,
        CAST(CASE p_size % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 12.0 ELSE 18.0 END AS DOUBLE) AS gst_rate,
        'Supplier#' || lpad(CAST(p_partkey // 15 AS VARCHAR), 9, '0') AS vendor_name,
        p_size % 4 = 0 AS is_preferred, p_size % 10 <> 0 AS active FROM part""",
    ),
    "vendors": (
        (),
        """SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS city,
        CASE WHEN s_nationkey % 7 = 0 THEN lower(tax) ELSE tax END AS gst FROM (
          SELECT *, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0')
            || 'F1Z' || (s_suppkey % 10) AS tax FROM supplier)""",
    ),
    "purchases": (
        ("objects", "materials", "vendors"),
        f"""SELECT project_id, v.name AS vendor_name, material_id, quantity, {money_sql('quantity * m.rate')} AS total
        FROM (SELECT *, {_QTY} AS quantity FROM objects) o JOIN materials m ON m.id = o.material_id
        JOIN vendors v ON v.id = o.supplier_id""",
    ),
    "versions": (
        (),
        """SELECT o_orderkey AS id, o_custkey AS project_id, 'v' || epoch_ms(o_orderdate) AS version_label,
        o_totalprice AS total, o_orderdate AS created_at FROM orders""",
    ),
    "rates": (
        (),
        f"""SELECT l_partkey AS material_id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS valid_from,
        min({money_sql('l_extendedprice / l_quantity')}) AS rate FROM lineitem GROUP BY 1, 2""",
    ),
    "changes": (
        (),
        f"""SELECT event_id % {LINE_SPAN_SQL} * 3 AS boq_item_id,
        CASE WHEN event_type IN ('purchase','view') THEN value * 100.0 END AS total,
        CASE WHEN event_type IN ('purchase','click') THEN value END AS rate,
        CASE WHEN event_type = 'signup' THEN 'Material ' || regexp_extract(props, '(\\d+)', 1) END AS material_name,
        ts, event_id FROM events""",
    ),
    "log": (
        (),
        """SELECT ts, user_id AS key, event_type AS route, event_type = 'error' AS failed, value / 25.0 AS latency, event_id
        FROM events""",
    ),
    "reports": (
        (),
        """SELECT event_id // 4 AS drawing_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'pending'
        WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'processed' ELSE 'error' END AS status, ts FROM events""",
    ),
    "detections": (
        (),
        """SELECT user_id AS project_id, event_id AS drawing_id, pos, object_type, label, confidence, quantity_estimate, trade, unit
        FROM events, LATERAL (VALUES
          (0, event_type, 'L' || user_id, user_id / 100.0, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE), NULL, 'nos'),
          (1, NULL, NULL, NULL, NULL, 'Civil', NULL),
          (2, 'door', NULL, -1.0, NULL, NULL, NULL)) AS d(pos, object_type, label, confidence, quantity_estimate, trade, unit)
        WHERE event_id % 5 IN (0, 1, 4)""",
    ),
    "truth": (
        (),
        """SELECT o_orderkey AS project_id, 'Civil' AS trade, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN NULL
          WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE floor(o_totalprice) END AS computed_total, floor(o_totalprice + 10) AS expected_total,
          floor(o_totalprice) AS amount, o_orderkey % 3 <> 0 AS computed_given FROM orders
        UNION ALL SELECT o_orderkey, 'Paint', NULL, 100.0, NULL, false FROM orders""",
    ),
}


def sql_with(views: tuple[str, ...], body: str) -> str:
    """A query over the named views, with everything they are built on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    body = body.strip()
    ctes = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if body[:5].upper() == "WITH ":
        if not ctes:
            return body
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
