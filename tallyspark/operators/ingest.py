"""Detections on their way to stored objects, and objects on their way to a plan view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schema as S
from tallyspark.functions.numbers import clamp01, half_up
from tallyspark.functions.text import object_category
from tallyspark.rules import COUNTED_TYPES, FALLBACK_DETECTIONS, literal_table


def normalised(
    detections: DataFrame,
    default_confidence: float | None = None,
    source: str = "ai",
    model: str = "",
) -> DataFrame:
    """Stored form of parsed detections (`o` as read from a response)."""
    box = F.col("o.bbox")
    confidence = clamp01(F.col("o.confidence"))
    if default_confidence is not None:
        confidence = F.coalesce(confidence, F.lit(default_confidence))
    return detections.select(
        *[c for c in detections.columns if c != "o"],
        F.coalesce("o.object_type", F.lit("unknown")).alias("object_type"),
        F.col("o.label").alias("label"),
        F.when(
            box.isNotNull(),
            F.struct(
                box["x"].alias("x"),
                box["y"].alias("y"),
                F.coalesce(box["width"], box["w"]).alias("width"),
                F.coalesce(box["height"], box["h"]).alias("height"),
            ),
        ).alias("bbox"),
        confidence.alias("confidence"),
        F.col("o.trade").alias("trade"),
        F.col("o.material_hint").alias("material_hint"),
        F.col("o.quantity_estimate").alias("quantity_estimate"),
        F.col("o.unit").alias("unit"),
        F.lit(model).alias("detection_model"),
        F.lit(source).alias("detection_source"),
    )


def plan_objects(objects: DataFrame) -> DataFrame:
    """Objects with a flat box: stored columns first, then the JSON box, then zero."""
    x, y, w, h = (
        F.coalesce(F.col(column), F.col(f"bbox.{part}"), F.lit(0.0))
        for column, part in (("bbox_x", "x"), ("bbox_y", "y"), ("length_mm", "width"), ("width_mm", "height"))
    )
    return objects.select(
        "id",
        "drawing_id",
        "object_type",
        "label",
        x.alias("bbox_x"),
        y.alias("bbox_y"),
        w.alias("length"),
        h.alias("width"),
        F.col("area_mm2").alias("area"),
        F.col("trade").alias("layer"),
        "confidence",
        F.array(x, y, w, h).alias("bbox_coords"),
        F.coalesce("detection_source", F.lit("ai")).alias("detection_source"),
    )


def to_millimetres(plan: DataFrame, sheet_width: float = 15_000.0, sheet_height: float = 10_000.0) -> DataFrame:
    """Positions given as parts of the sheet, in millimetres."""
    return plan.withColumns(
        {
            "bbox_x": F.col("bbox_x") * sheet_width,
            "bbox_y": F.col("bbox_y") * sheet_height,
            "length": F.col("length") * sheet_width,
            "width": F.col("width") * sheet_height,
        }
    )


def fit_to_view(plan: DataFrame, view_width: float, view_height: float, pad: float = 40.0) -> DataFrame:
    """Extents of each drawing, and the scale and offsets that fit it into a view."""
    box = plan.groupBy("drawing_id").agg(
        F.min("bbox_x").alias("min_x"),
        F.min("bbox_y").alias("min_y"),
        F.max(F.col("bbox_x") + F.col("length")).alias("max_x"),
        F.max(F.col("bbox_y") + F.col("width")).alias("max_y"),
    )
    w = F.greatest(F.lit(1.0), F.col("max_x") - F.col("min_x"))
    h = F.greatest(F.lit(1.0), F.col("max_y") - F.col("min_y"))
    scale = F.least(F.lit(view_width - 2 * pad) / w, F.lit(view_height - 2 * pad) / h)
    return box.select(
        "drawing_id",
        "min_x",
        "min_y",
        "max_x",
        "max_y",
        scale.alias("scale"),
        ((F.lit(view_width) - w * scale) / 2 - F.col("min_x") * scale).alias("offset_x"),
        ((F.lit(view_height) - h * scale) / 2 - F.col("min_y") * scale).alias("offset_y"),
    )


def seed_quantity(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), half_up(width * height * F.lit(100)))


def seed_unit(object_type: Column, counted: Sequence[str] = COUNTED_TYPES) -> Column:
    return F.when(object_type.isin(*counted), "nos").otherwise("sqft")


def fallback_array(template: Sequence[tuple] = FALLBACK_DETECTIONS) -> Column:
    """The template as a literal array in the shape of parsed detections."""
    rows = [
        F.struct(
            F.lit(kind).alias("object_type"),
            F.lit(label).alias("label"),
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"),
                     F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h")).alias("bbox"),
            F.lit(0.8).alias("confidence"),
            F.lit(trade).alias("trade"),
            F.lit(None).cast("string").alias("material_hint"),
            seed_quantity(F.lit(w), F.lit(h)).cast("double").alias("quantity_estimate"),
            seed_unit(F.lit(kind)).alias("unit"),
        ).cast(S.DETECTION)
        for kind, label, x, y, w, h, trade in template
    ]
    return F.array(*rows)


def with_fallback(
    drawings: DataFrame, detections: DataFrame, template: Sequence[tuple] = FALLBACK_DETECTIONS
) -> DataFrame:
    """Detections of all drawings with their `origin`; a drawing whose call failed gets the template.

    An answer that is empty or unreadable gives no objects. The template is
    exploded from a literal array, so no cross join is needed.
    """
    empty = drawings.where(F.col("failed")).select("project_id", "drawing_id").join(
        detections.select("drawing_id").distinct(), "drawing_id", "left_anti"
    )
    filled = empty.select("project_id", "drawing_id", F.posexplode(fallback_array(template)).alias("pos", "o"))
    found = detections.select("project_id", "drawing_id", "pos", "o", F.lit("response").alias("origin"))
    return found.unionByName(filled.withColumn("origin", F.lit("template")))


def drawing_status(drawings: DataFrame, objects: DataFrame) -> DataFrame:
    """Status of each drawing with the number of its objects, 0 when it has none."""
    counts = object_counts(objects)
    return drawings.select(F.col("id").alias("drawing_id"), "status").join(counts, "drawing_id", "left").select(
        "drawing_id", "status", F.coalesce("objects", F.lit(0)).cast("long").alias("objects_detected")
    )


def object_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("drawing_id").agg(F.count("*").alias("objects"))


def type_counts(objects: DataFrame, types: Sequence[str]) -> DataFrame:
    """Objects per project and type, one column per named type."""
    wide = objects.groupBy("project_id").agg(
        *[F.count_if(F.col("object_type") == t).alias(f"n_{t.lower()}") for t in types],
        F.count("*").alias("n_all"),
    )
    return wide


def rule_coverage(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Each object type in use with its number of objects and its rule, if any."""
    used = objects.groupBy("object_type").agg(F.count("*").alias("objects"))
    return used.join(rules.select("object_type", "trade", "unit", "rate"), "object_type", "left")


def with_attributes(plan: DataFrame, attributes: Sequence[tuple]) -> DataFrame:
    """Drawing class and default height by the category of the object type."""
    table = literal_table(plan.sparkSession, attributes, "category string, cls string, height3d double")
    return plan.withColumn("category", object_category(F.col("object_type"))).join(table, "category", "left")
