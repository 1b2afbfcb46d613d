"""Material catalogue: search, candidates for lines, choices, purchase lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numbers import money, sum_money, sum_quantity
from tallyspark.functions.text import brand_and_name
from tallyspark.operators.boq import trade_name
from tallyspark.operators.textmatch import contains_pairs, prefixes

CANDIDATES = 20


def search(
    materials: DataFrame, q: str | None = None, category: str | None = None, limit: int | None = None
) -> DataFrame:
    """Catalogue page: part of the name in any case, exact category, by name."""
    found = materials
    if category:
        found = found.where(F.col("category") == category)
    if q:
        found = found.where(F.contains(F.lower("name"), F.lit(q.lower())))
    found = found.orderBy(F.asc_nulls_last("name"), "id")
    return found.limit(limit) if limit else found


def holds_text(q: str) -> Column:
    """Whether name, brand or category holds the text; an empty text is held by all."""
    text = F.lit(q.lower())
    return (
        F.contains(F.lower("name"), text)
        | F.contains(F.lower("brand"), text)
        | F.contains(F.lower("category"), text)
    )


def matching_any(materials: DataFrame, q: str) -> DataFrame:
    return materials.where(holds_text(q)) if q else materials


def catalogue_counts(materials: DataFrame, q: str) -> DataFrame:
    """Preferred materials, and materials matching a text, per category."""
    return materials.groupBy("category").agg(
        F.count_if(F.col("is_preferred")).alias("preferred"), F.count_if(holds_text(q)).alias("matching")
    )


def line_patterns(lines: DataFrame) -> DataFrame:
    """The different (trade, material_name) pairs of the lines; missing ones as ''."""
    return lines.select(
        F.coalesce("trade", F.lit("")).alias("trade"),
        F.coalesce("material_name", F.lit("")).alias("material_name"),
    ).distinct()


def _best(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("material_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _by_prefix(materials: DataFrame, column: str, wanted: DataFrame, k: int) -> DataFrame:
    """The first k materials for each wanted prefix of a catalogue column."""
    rows = materials.select(
        F.col("id").alias("material_id"), F.explode(prefixes(F.lower(column))).alias("prefix")
    )
    return _best(rows.join(wanted, "prefix", "left_semi"), ["prefix"], k).drop("rank")


def candidates_by_pattern(patterns: DataFrame, materials: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Active materials whose category starts with the trade or whose name starts
    with the material name, the first k by id for each pattern.

    The first k of a union are among the first k of its parts, so each prefix
    keeps k materials before any join and no group is ever paired in full. An
    empty trade or name matches every material: its first k are the first k of
    the catalogue.
    """
    active = materials.where(F.col("active"))
    wanted = patterns.select(
        "trade",
        "material_name",
        F.explode(
            F.array(
                F.struct(F.lit("category").alias("side"), F.lower("trade").alias("prefix")),
                F.struct(F.lit("name").alias("side"), F.lower("material_name").alias("prefix")),
            )
        ).alias("w"),
    ).select("trade", "material_name", "w.*")
    first = active.orderBy("id").limit(k).select(F.lit("").alias("prefix"), F.col("id").alias("material_id"))
    sides = [
        _by_prefix(active, side, wanted.where(F.col("side") == side).select("prefix"), k)
        .unionByName(first)
        .withColumn("side", F.lit(side))
        for side in ("category", "name")
    ]
    index = sides[0].unionByName(sides[1])
    pairs = wanted.join(index, ["side", "prefix"]).select("trade", "material_name", "material_id").distinct()
    return _best(pairs, ["trade", "material_name"], k)


def candidates_for_lines(lines: DataFrame, materials: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The candidates of every line, through the patterns lines share."""
    found = candidates_by_pattern(line_patterns(lines), materials, k)
    keyed = lines.select(
        F.col("id").alias("boq_item_id"),
        F.coalesce("trade", F.lit("")).alias("trade"),
        F.coalesce("material_name", F.lit("")).alias("material_name"),
    )
    return keyed.join(found, ["trade", "material_name"])


def candidates_by_word(patterns: DataFrame, materials: DataFrame) -> DataFrame:
    """Materials of the trade's own category, or holding the first word of the
    material name; all of them, per pattern."""
    keyed = patterns.withColumn("word", F.get(F.split(F.lower("material_name"), " "), F.lit(0)))
    catalogue = materials.select(F.col("id").alias("material_id"), "category", F.lower("name").alias("text"))
    same = keyed.join(catalogue, F.col("trade") == F.col("category")).select("trade", "material_name", "material_id")
    words = contains_pairs(catalogue.select("text"), keyed.select(F.col("word").alias("pattern")))
    named = (
        keyed.join(words, F.col("word") == F.col("pattern"))
        .join(catalogue, "text")
        .select("trade", "material_name", "material_id")
    )
    return same.unionByName(named).distinct()


def choose_materials(lines: DataFrame, choices: DataFrame, materials: DataFrame) -> DataFrame:
    """Put the chosen material on each line; lines without a choice stay as they are.

    The total keeps the quantity; tax is a separate column.
    """
    picked = choices.select(F.col("boq_item_id").alias("id"), F.col("material_id").alias("_chosen")).join(
        materials.select(
            F.col("id").alias("_chosen"),
            brand_and_name(F.col("brand"), F.col("name")).alias("_name"),
            F.col("rate").cast("double").alias("_rate"),
            F.coalesce(F.col("gst_rate").cast("double"), F.lit(0.0)).alias("_gst"),
        ),
        "_chosen",
    )
    joined = lines.join(picked, "id", "left")
    chosen = F.col("_chosen").isNotNull()
    total = F.when(chosen, money(F.col("quantity") * F.coalesce("_rate", F.lit(0.0)))).otherwise(F.col("total"))
    return joined.select(
        *[c for c in lines.columns if c not in ("material_id", "material_name", "rate", "total")],
        F.coalesce("_chosen", "material_id").alias("material_id"),
        F.when(chosen, F.col("_name")).otherwise(F.col("material_name")).alias("material_name"),
        F.when(chosen, F.col("_rate")).otherwise(F.col("rate")).alias("rate"),
        total.alias("total"),
        F.when(chosen, tax_included(total, F.col("_gst"))).otherwise(total).alias("total_with_tax"),
    )


def tax_included(amount: Column, gst_rate: Column) -> Column:
    return amount * (F.lit(1.0) + F.coalesce(gst_rate, F.lit(0.0)) / F.lit(100.0))


def alternatives(requested: DataFrame, materials: DataFrame) -> DataFrame:
    """All other materials in the category of each requested material (`material_id`)."""
    base = requested.select("material_id").join(
        materials.select(F.col("id").alias("material_id"), "category"), "material_id"
    )
    other = materials.select(F.col("id").alias("alternative_id"), "category", "name", "rate")
    return base.join(other, "category").where(F.col("alternative_id") != F.col("material_id"))


def alternative_report(materials: DataFrame) -> DataFrame:
    """For every material: how many alternatives it has and the cheapest of them.

    The two cheapest of a category answer this for all its members, so no pairs
    are formed.
    """
    order = Window.partitionBy("category").orderBy("rate", "id")
    ranked = (
        materials.select("category", "id", "rate")
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= 2)
    )
    cheapest = ranked.groupBy("category").agg(
        F.max(F.when(F.col("r") == 1, F.struct("id", "rate"))).alias("first"),
        F.max(F.when(F.col("r") == 2, F.struct("id", "rate"))).alias("second"),
    )
    sizes = materials.groupBy("category").agg(F.count("*").alias("n"))
    per_category = sizes.join(cheapest, "category")
    joined = materials.select("id", "category", "rate").join(per_category, "category")
    best = F.when(F.col("id") == F.col("first.id"), F.col("second")).otherwise(F.col("first"))
    return joined.select(
        F.col("id").alias("material_id"),
        (F.col("n") - 1).alias("alternatives"),
        best["id"].alias("cheapest_id"),
        best["rate"].alias("cheapest_rate"),
        money(F.col("rate") - best["rate"]).alias("saving"),
    )


def purchase_list(purchases: DataFrame) -> DataFrame:
    """Quantity and amount to buy per project, vendor and material."""
    return purchases.groupBy("project_id", "vendor_name", "material_id").agg(
        F.count("*").alias("lines"),
        sum_quantity(F.col("quantity")).alias("quantity"),
        sum_money(F.col("total")).alias("total"),
    )


def materials_summary(lines: DataFrame) -> DataFrame:
    """Quantity and amount per project and material."""
    return lines.groupBy("project_id", F.coalesce("material_name", F.lit("")).alias("material_name")).agg(
        F.count("*").alias("lines"),
        sum_quantity(F.col("quantity")).alias("quantity"),
        sum_money(F.col("total")).alias("total"),
    )


def unmapped_rates(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Names in use that a rate table does not know, with their number of uses."""
    counted = used.groupBy(column).agg(F.count("*").alias("uses"))
    return counted.join(known.select(column).distinct(), column, "left_anti")


def labour_costs(lines: DataFrame, labour_rates: DataFrame) -> DataFrame:
    """Labour amount of each line from the rate of its trade.

    Several rates of one trade (by category) would multiply lines, so the
    lowest is used.
    """
    rate = labour_rates.groupBy("trade").agg(F.min("rate").cast("double").alias("labour_rate"))
    return lines.join(rate, "trade", "left").withColumn(
        "labour_cost", money(F.col("quantity") * F.coalesce("labour_rate", F.lit(0.0)))
    )


def with_wastage(lines: DataFrame, wastage: DataFrame) -> DataFrame:
    """Quantity raised by the wastage percentage of the material, the highest if a material has several."""
    known = wastage.groupBy("material_name").agg(F.max("wastage_pct").alias("wastage_pct"))
    return lines.join(known, "material_name", "left").withColumn(
        "quantity_with_wastage",
        F.col("quantity") * (F.lit(1.0) + F.coalesce("wastage_pct", F.lit(0.0)) / F.lit(100.0)),
    )


def durations(lines: DataFrame, labour_rates: DataFrame) -> DataFrame:
    """Days per project and trade: quantity over daily productivity.

    A trade without a productivity has no duration.
    """
    speed = labour_rates.groupBy("trade").agg(F.max("productivity").cast("double").alias("productivity"))
    amounts = lines.groupBy("project_id", trade_name().alias("trade")).agg(
        sum_quantity(F.col("quantity")).alias("quantity")
    )
    return amounts.join(speed, "trade", "left").select(
        "project_id",
        "trade",
        "quantity",
        F.when(F.col("productivity") > 0, F.col("quantity") / F.col("productivity")).alias("days"),
    )


def project_durations(trade_days: DataFrame) -> DataFrame:
    """Days when trades follow each other, and when they run side by side."""
    rounded = F.floor(F.col("days") * 10_000 + 0.5).cast("long")
    return trade_days.groupBy("project_id").agg(
        (F.sum(rounded) / F.lit(10_000.0)).alias("days_in_sequence"),
        (F.max(rounded) / F.lit(10_000.0)).alias("days_in_parallel"),
    )
