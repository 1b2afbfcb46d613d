"""Nested JSON fixtures: expected counts and bills of reference projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUTH = (
    "struct<trades:array<struct<trade:string,computed_total:double,expected_total:double,"
    "items:array<struct<description:string,amount:double,formula:string,rate:double>>>>>"
)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file, possibly over many lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per line; splittable."""
    return spark.read.schema(schema).json(path)


def named_fixtures(spark: SparkSession, path: str, names: list[str], fields: str) -> DataFrame:
    """A document with one object per fixture, as one row per fixture."""
    schema = ", ".join(f"{n} struct<{fields}>" for n in names)
    doc = read_documents(spark, path, schema)
    entry = F.array(*[F.struct(F.lit(n).alias("fixture"), F.col(f"{n}.*")) for n in names])
    return doc.select(F.inline(entry))


def parse_truth(text: Column) -> Column:
    """Nested bill of a reference project from JSON text, or null.

    Each trade tells by `computed_given` whether it has a computed total at all, be it null.
    """
    parsed, fields = F.from_json(text, TRUTH), F.from_json(text, "struct<trades:array<map<string,string>>>")
    given = lambda trade, names: trade.withField(
        "computed_given", F.coalesce(F.map_contains_key(names, "computed_total"), F.lit(False))
    )
    trades = F.zip_with(parsed["trades"], fields["trades"], given)
    return F.when(parsed.isNotNull(), F.struct(trades.alias("trades")))


def truth_trades(documents: DataFrame, key: str = "project_id", truth: str = "truth") -> DataFrame:
    """One row per trade; where the fields of the JSON are not known, a null computed total counts as absent."""
    rows = documents.select(key, F.posexplode_outer(f"{truth}.trades").alias("trade_no", "t"))
    known = "computed_given" in rows.schema["t"].dataType.fieldNames()
    given = F.coalesce("t.computed_given", F.lit(False)) if known else F.col("t.computed_total").isNotNull()
    return rows.select(
        key, "trade_no", F.col("t.trade").alias("trade"), "t.computed_total", "t.expected_total", "t.items", given.alias("computed_given")
    )


def truth_items(documents: DataFrame, key: str = "project_id", truth: str = "truth") -> DataFrame:
    """One row per item; trades without items give one row with an empty item."""
    return (
        truth_trades(documents, key, truth)
        .select(key, "trade_no", "trade", F.posexplode_outer("items").alias("item_no", "i"))
        .select(key, "trade_no", "trade", "item_no", "i.amount", "i.formula", "i.rate")
    )
