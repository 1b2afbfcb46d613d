"""Quantity rules, label overrides and other small reference tables.

Rule tables are configuration. They are turned into literal relations, whose
exact size Spark knows, so the optimizer broadcasts them below
`spark.sql.autoBroadcastJoinThreshold` and shuffles them beyond it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema as S

RULESET_VERSION = "office_india_v1"

# Object type, trade, unit, rate, material, priced by area (1) or by count (0).
QUANTITY_RULES = (
    ("reception_area", "Modular Furniture", "nos", 85000.0, "Reception counter + waiting area", 0),
    ("meeting_pod", "Modular Furniture", "nos", 120000.0, "Acoustic meeting pod 2-seater", 0),
    ("cabin", "Modular Furniture", "nos", 85000.0, "Cabin partition + furniture", 0),
    ("linear_workstation", "Modular Furniture", "nos", 28000.0, "Linear workstation 4x2ft", 0),
    ("meeting_room_10pax", "Modular Furniture", "nos", 250000.0, "Meeting room 10-seat fit-out", 0),
    ("meeting_room_6pax", "Modular Furniture", "nos", 180000.0, "Meeting room 6-seat fit-out", 0),
    ("server_room", "Modular Furniture", "nos", 180000.0, "Server room fit-out", 0),
    ("store_room", "Carpentry", "nos", 45000.0, "Shelving + storage", 0),
    ("cafeteria", "Modular Furniture", "nos", 180000.0, "Cafeteria 13-pax fit-out", 0),
    ("ladies_toilet", "Plumbing", "nos", 85000.0, "Ladies toilet fixtures + tiling", 0),
    ("gents_toilet", "Plumbing", "nos", 85000.0, "Gents toilet fixtures + tiling", 0),
    ("phone_booth", "Modular Furniture", "nos", 120000.0, "Acoustic phone booth", 0),
    ("wall", "Civil", "sft", 85.0, "Brick masonry", 1),
    ("partition", "Gypsum", "sft", 200.0, "Gypsum board 75mm", 1),
    ("glass_partition", "Gypsum", "sft", 650.0, "Toughened glass 10mm", 1),
    ("door", "Carpentry", "nos", 27000.0, "Flush door", 0),
    ("window", "Carpentry", "nos", 8500.0, "Aluminium window", 0),
    ("furniture", "Modular Furniture", "nos", 23000.0, "Workstation 1200×750", 0),
    ("workstation", "Modular Furniture", "nos", 23000.0, "Workstation 1200×750", 0),
    ("meeting_room", "Modular Furniture", "nos", 150000.0, "Meeting room fit-out", 0),
    ("reception", "Modular Furniture", "nos", 65000.0, "Reception counter", 0),
    ("pantry", "Modular Furniture", "nos", 85000.0, "Pantry counter + sink", 0),
    ("toilet", "Plumbing", "nos", 65000.0, "Toilet accessories", 0),
    ("electrical", "Electrical", "points", 2250.0, "Wiring + accessory", 0),
    ("ceiling", "Gypsum", "sft", 160.0, "Gypsum false ceiling", 1),
    ("column", "Civil", "nos", 6500.0, "RCC column", 0),
    ("lift", "Civil", "nos", 0.0, "Existing lift", 0),
    ("staircase", "Civil", "nos", 0.0, "Existing staircase", 0),
    ("duct", "Civil", "nos", 0.0, "Existing duct", 0),
    ("passage", "Civil", "sft", 0.0, "Existing passage", 1),
    ("storage", "Carpentry", "nos", 45000.0, "Shelving + storage", 0),
    ("room", "Civil", "sft", 85.0, "Brick masonry", 1),
)

# Order, words inside the label of a room, and the rule that then applies.
LABEL_OVERRIDES = (
    (1, "reception", "Modular Furniture", "nos", 85000.0, "Reception counter + waiting area", 0),
    (2, "meeting pod", "Modular Furniture", "nos", 120000.0, "Acoustic meeting pod 2-seater", 0),
    (3, "cabin", "Modular Furniture", "nos", 85000.0, "Cabin partition + furniture", 0),
    (4, "server room", "Modular Furniture", "nos", 180000.0, "Server room fit-out", 0),
    (5, "store room", "Carpentry", "nos", 45000.0, "Shelving + storage", 0),
    (6, "cafeteria", "Modular Furniture", "nos", 180000.0, "Cafeteria 13-pax fit-out", 0),
    (7, "phone booth", "Modular Furniture", "nos", 120000.0, "Acoustic phone booth", 0),
    (8, "discussion", "Modular Furniture", "nos", 95000.0, "Discussion booth", 0),
    (9, "ladies toilet", "Plumbing", "nos", 85000.0, "Ladies toilet fixtures + tiling", 0),
    (10, "gents toilet", "Plumbing", "nos", 85000.0, "Gents toilet fixtures + tiling", 0),
)

# Key, label and family of the object types offered to users.
OBJECT_TYPES = (
    ("wall", "Wall", "structure"),
    ("partition", "Partition", "structure"),
    ("door", "Door", "opening"),
    ("window", "Window", "opening"),
    ("furniture", "Furniture", "furnishing"),
    ("electrical", "Electrical", "services"),
    ("ceiling", "Ceiling", "finish"),
    ("column", "Column", "structure"),
)

# Trades a usual interior fit-out has.
TYPICAL_TRADES = (
    "Civil", "Plumbing", "Gypsum", "Carpentry", "Painting", "Modular Furniture", "Electrical", "HVAC",
)

# Detections a drawing gets when none came back
# (object type, label, x, y, width, height, trade).
FALLBACK_DETECTIONS = (
    ("cabin", "Manager Cabin", 0.08, 0.08, 0.18, 0.22, "Carpentary"),
    ("cabin", "Manager Cabin", 0.30, 0.08, 0.18, 0.22, "Carpentary"),
    ("cabin", "Manager Cabin", 0.52, 0.08, 0.18, 0.22, "Carpentary"),
    ("door", "Glass Door", 0.15, 0.30, 0.04, 0.04, "Carpentary"),
    ("door", "Glass Door", 0.45, 0.30, 0.04, 0.04, "Carpentary"),
    ("furniture", "Workstation", 0.05, 0.50, 0.10, 0.06, "Modular Furniture"),
    ("furniture", "Workstation", 0.18, 0.50, 0.10, 0.06, "Modular Furniture"),
    ("furniture", "Conference Table", 0.35, 0.55, 0.20, 0.10, "Modular Furniture"),
    ("partition", "Gypsum Partition", 0.28, 0.05, 0.02, 0.40, "Civil"),
    ("partition", "Gypsum Partition", 0.50, 0.05, 0.02, 0.40, "Civil"),
    ("ceiling", "Gypsum Ceiling", 0.10, 0.10, 0.40, 0.60, "Gypsum"),
    ("electrical", "Light Point", 0.15, 0.20, 0.02, 0.02, "Electrical"),
    ("electrical", "Light Point", 0.30, 0.20, 0.02, 0.02, "Electrical"),
    ("electrical", "Light Point", 0.50, 0.20, 0.02, 0.02, "Electrical"),
    ("window", "Window", 0.04, 0.10, 0.04, 0.08, "Carpentary"),
    ("window", "Window", 0.04, 0.40, 0.04, 0.08, "Carpentary"),
    ("wall", "External Wall", 0.00, 0.00, 0.60, 0.80, "Civil"),
    ("wall", "External Wall", 0.60, 0.00, 0.60, 0.80, "Civil"),
    ("column", "Column", 0.12, 0.18, 0.03, 0.03, "Civil"),
    ("column", "Column", 0.40, 0.18, 0.03, 0.03, "Civil"),
)

# Object types counted in pieces when a quantity is seeded.
COUNTED_TYPES = ("door", "window", "column", "electrical", "furniture")


def _literal(value: object, kind: str) -> str:
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = str(value).lower()
    elif isinstance(value, str):
        text = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    else:
        text = repr(value)
    return f"CAST({text} AS {kind})"


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small table of plain columns as a literal relation with exact statistics."""
    rows = list(rows)
    fields = [field.split() for field in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    names = ", ".join(f"`{name}`" for name, _ in fields)
    body = ", ".join(
        "(" + ", ".join(_literal(v, kind) for v, (_, kind) in zip(row, fields)) + ")" for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


@dataclass(frozen=True)
class RuleSet:
    """Quantity rules by object type and ordered label overrides for one type."""

    rules: Sequence[tuple] = QUANTITY_RULES
    overrides: Sequence[tuple] = LABEL_OVERRIDES
    override_type: str = "room"
    version: str = RULESET_VERSION
    object_types: Sequence[tuple] = field(default=OBJECT_TYPES)

    def rules_table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, self.rules, S.RULE_ROW)

    def overrides_table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, self.overrides, S.OVERRIDE_ROW)

    def object_types_table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, self.object_types, "key string, label string, family string")


def active_rules(boq_rules: DataFrame, version: str, counted_units: Sequence[str] = ("nos", "points")) -> DataFrame:
    """User-kept rules of one version, in the shape `expand_lines` takes.

    Of several active rules of a type the one with the lowest key is used.
    """
    chosen = (
        boq_rules.where(F.col("active") & (F.col("ruleset_version") == version))
        .groupBy("object_type")
        .agg(F.min_by(F.struct("trade", "unit", "rate", "material"), "key").alias("r"))
    )
    return chosen.select(
        "object_type",
        F.col("r.trade").alias("trade"),
        F.coalesce("r.unit", F.lit("")).alias("unit"),
        F.coalesce(F.col("r.rate").cast("double"), F.lit(0.0)).alias("rate"),
        F.coalesce("r.material", F.lit("")).alias("material"),
        F.when(F.lower("r.unit").isin(*counted_units), 0).otherwise(1).alias("per_area"),
    )


def keyword_overrides(boq_rules: DataFrame, version: str, counted_units: Sequence[str] = ("nos", "points")) -> DataFrame:
    """Override rows from the comma-separated keywords of user-kept rules."""
    words = boq_rules.where(
        F.col("active") & (F.col("ruleset_version") == version) & F.col("keywords").isNotNull()
    ).select("*", F.posexplode(F.split("keywords", ",")).alias("pos", "word"))
    return words.select(
        F.struct(F.col("id").cast("long").alias("id"), "pos").alias("priority"),
        F.lower(F.trim("word")).alias("key"),
        "trade",
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce(F.col("rate").cast("double"), F.lit(0.0)).alias("rate"),
        F.coalesce("material", F.lit("")).alias("material"),
        F.when(F.lower("unit").isin(*counted_units), 0).otherwise(1).alias("per_area"),
    ).where(F.col("key") != "")
