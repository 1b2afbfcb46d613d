"""Expansion of detected objects into priced bill lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import half_up, money
from tallyspark.functions.text import line_description
from tallyspark.operators.textmatch import contains_pairs
from tallyspark.rules import RULESET_VERSION, RuleSet

MAX_INLINE_OVERRIDES = 50
_OVERRIDE_FIELDS = ("trade", "unit", "rate", "material", "per_area")


def first_override(label: Column, overrides: list) -> Column:
    """The first override whose key is inside the label, as a struct or null.

    A chain of conditions over literals, which stays inside generated code.
    """
    text = F.lower(F.coalesce(label, F.lit("")))
    chosen = None
    for o in sorted(overrides, key=lambda o: (o["priority"], o["key"])):
        rule = F.struct(F.lit(o["key"]).alias("key"), *[F.lit(o[f]).alias(f) for f in _OVERRIDE_FIELDS])
        inside = F.contains(text, F.lit(o["key"]))
        chosen = F.when(inside, rule) if chosen is None else chosen.when(inside, rule)
    return chosen


def with_override(
    objects: DataFrame, overrides: DataFrame, override_type: str, max_inline: int = MAX_INLINE_OVERRIDES
) -> DataFrame:
    """Add `override`, the rule struct chosen by the label, null where none applies.

    A short list becomes a literal inside the row expression, with no join. A
    longer one is matched on the different labels and joined back by label. Both
    give the same rows: empty keys match nothing, equal priorities go by key.
    """
    concerned = F.col("object_type") == override_type
    overrides = overrides.where(F.length("key") > 0)
    short = overrides.limit(max_inline + 1).collect()
    if not short:
        return objects.withColumn("override", F.lit(None).cast(
            "struct<key:string,trade:string,unit:string,rate:double,material:string,per_area:int>"))
    if len(short) <= max_inline:
        return objects.withColumn("override", F.when(concerned, first_override(F.col("label"), short)))
    labels = objects.where(concerned).select(F.lower("label").alias("text"))
    pairs = contains_pairs(labels, overrides.select(F.col("key").alias("pattern")))
    chosen = (
        pairs.join(overrides, F.col("pattern") == F.col("key"))
        .groupBy("text")
        .agg(F.min_by(F.struct("key", *_OVERRIDE_FIELDS), F.struct("priority", "key")).alias("override"))
    )
    # rows the overrides do not concern get spread keys that match nothing
    other = F.concat(F.lit("\u0000"), (F.xxhash64("drawing_id", "id") % 997).cast("string"))
    needed = F.coalesce(F.when(concerned, F.lower("label")), other)
    return objects.withColumn("_text", needed).join(
        chosen.withColumnRenamed("text", "_text"), "_text", "left"
    ).drop("_text")


def line_quantity(per_area: Column, estimate: Column, use_estimate_for_counts: bool = False) -> Column:
    """Rounded area for area rules, one piece for counted ones."""
    raw = F.when(estimate > 0, estimate).otherwise(F.lit(1.0))
    counted = half_up(raw) if use_estimate_for_counts else F.lit(1).cast("long")
    return F.when(per_area != 0, half_up(raw)).otherwise(counted)


def expand_lines(
    objects: DataFrame,
    rules: DataFrame,
    overrides: DataFrame,
    override_type: str = "room",
    ruleset_version: str = RULESET_VERSION,
    use_estimate_for_counts: bool = False,
) -> DataFrame:
    """One bill line per object that has a rule, for all projects at once.

    The id of a line is a hash of its object and the version of the rules, so a
    rerun gives the same ids.

    The rule join carries no hint: a literal rule table is broadcast by its
    known size, a large one is shuffled and AQE splits a hot object type.
    """
    rule = rules.select(
        "object_type", F.struct(*_OVERRIDE_FIELDS).alias("rule")
    )
    matched = with_override(objects, overrides, override_type).join(rule, "object_type")
    chosen = {
        f: F.when(F.col("override").isNotNull(), F.col(f"override.{f}")).otherwise(F.col(f"rule.{f}"))
        for f in _OVERRIDE_FIELDS
    }
    quantity = line_quantity(chosen["per_area"], F.col("quantity_estimate"), use_estimate_for_counts)
    return matched.select(
        "project_id",
        "drawing_id",
        F.xxhash64(F.col("id"), F.lit(ruleset_version)).alias("id"),
        F.col("id").alias("detected_object_id"),
        line_description(F.col("label"), F.col("object_type"), chosen["material"]).alias("description"),
        chosen["trade"].alias("trade"),
        chosen["material"].alias("material_name"),
        quantity.alias("quantity"),
        chosen["unit"].alias("unit"),
        chosen["rate"].alias("rate"),
        money(quantity * chosen["rate"]).alias("total"),
        F.lit(None).cast("long").alias("rule_id"),
        F.lit(ruleset_version).alias("ruleset_version"),
        F.lit(None).cast("string").alias("location"),
    )


def expand_with(objects: DataFrame, rule_set: RuleSet) -> DataFrame:
    spark = objects.sparkSession
    return expand_lines(
        objects,
        rule_set.rules_table(spark),
        rule_set.overrides_table(spark),
        rule_set.override_type,
        rule_set.version,
    )


def objects_without_rule(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects the rules do not cover; the expansion leaves them out."""
    return objects.join(rules.select("object_type"), "object_type", "left_anti")
