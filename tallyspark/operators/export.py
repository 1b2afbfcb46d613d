"""Deliverables: the bill as text sheet, and the sheets of a workbook."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents, from_cents
from tallyspark.operators.boq import project_totals, trade_summary
from tallyspark.operators.costing import cost_rollup
from tallyspark.operators.materials import materials_summary
from tallyspark.operators.ordered import id_block, numbered

TITLE = "Bill of Quantities"
HEADER = ("Trade", "Description", "Quantity", "Unit", "Rate", "Amount")
PREAMBLE_LINES = 5


def plain_number(x: Column) -> Column:
    """Number text without exponent and without trailing zeros, up to three decimals."""
    text = F.floor(F.abs(x) * 1000.0 + 0.5).cast("decimal(38,0)")
    whole = F.floor(text / F.lit(1000)).cast("decimal(38,0)")
    part = (text - whole * F.lit(1000)).cast("int")
    tail = F.regexp_replace(F.format_string(".%03d", part), r"\.?0+$", "")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), tail)


def cell(value: Column, quoted: bool) -> Column:
    """A cell; quoted when it holds a comma, a quote or a line break."""
    text = F.coalesce(value, F.lit(""))
    if not quoted:
        return text
    return F.when(
        text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(text)


def bill_sheet(
    lines: DataFrame, projects: DataFrame, at: datetime, legacy: bool = False, block_width: int = 1_000_000
) -> DataFrame:
    """The sheet of every project as (project_id, line_no, text).

    Preamble, header, lines by trade and id, grand total. Lines are numbered in
    blocks, so the lines of a large project are spread over tasks. `legacy`
    leaves cells unquoted.
    """
    head = projects.select(F.col("id").alias("project_id"), "name", "client")
    generated = F.date_format(F.lit(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    top = head.select(
        "project_id",
        F.posexplode(
            F.array(
                F.lit(TITLE),
                F.concat(F.lit("Project,"), cell(F.col("name"), not legacy)),
                F.concat(F.lit("Client,"), cell(F.col("client"), not legacy)),
                F.concat(F.lit("Generated,"), generated),
                F.lit(",".join(HEADER)),
            )
        ).alias("line_no", "text"),
    ).select("project_id", F.col("line_no").cast("long").alias("line_no"), "text")

    summary = trade_summary(lines)
    # blocks follow the order of the sheet: trade by trade, then ranges of ids
    named = lines.withColumn("order_name", F.coalesce("trade", F.lit("\uffff")))
    counted = numbered(
        named,
        ["project_id"],
        [F.col("order_name"), F.col("id")],
        F.struct("order_name", id_block("id", block_width).alias("ids")),
        "n",
    )
    texts = (
        F.coalesce("trade", F.lit("")),
        F.col("description"),
        plain_number(F.col("quantity").cast("double")),
        F.col("unit"),
        plain_number(F.col("rate").cast("double")),
        plain_number(F.col("total").cast("double")),
    )
    body = counted.select(
        "project_id",
        (F.col("n") + PREAMBLE_LINES - 1).alias("line_no"),
        F.concat_ws(",", *[cell(t, not legacy) for t in texts]).alias("text"),
    )
    totals = project_totals(summary).select("project_id", "total", "lines")
    bottom = head.select("project_id").join(totals, "project_id", "left").select(
        "project_id",
        (F.coalesce("lines", F.lit(0)) + PREAMBLE_LINES).cast("long").alias("line_no"),
        F.concat(F.lit(",,,,Grand Total,"), plain_number(F.coalesce("total", F.lit(0.0)))).alias("text"),
    )
    return top.unionByName(body).unionByName(bottom)


def write_sheets(sheet: DataFrame, path: str) -> None:
    """Sheets of all projects as one table, in order within and across its files.

    Range partitioning splits a large project over several files and puts many
    small projects into one, so the number of files follows the data.
    """
    sheet.repartitionByRange("project_id", "line_no").sortWithinPartitions("project_id", "line_no").write.parquet(path)


def write_text_sheets(sheet: DataFrame, path: str) -> None:
    """Text files, one folder per project, for the projects that are handed out."""
    (
        sheet.repartitionByRange("project_id", "line_no")
        .sortWithinPartitions("project_id", "line_no")
        .select("project_id", "text")
        .write.partitionBy("project_id")
        .text(path)
    )


_SHEET_ROW = "trade string, description string, quantity string, unit string, rate string, amount string"
_QUOTING = {"quote": '"', "escape": '"'}


def _bill_rows(rows: DataFrame) -> DataFrame:
    """Bill lines out of split rows; preamble, header and total are passed over."""
    kept = F.col("amount").isNotNull() & (F.col("amount") != HEADER[-1])
    return rows.where(kept & (F.coalesce("rate", F.lit("")) != "Grand Total")).select(
        "project_id",
        F.nullif("trade", F.lit("")).alias("trade"),
        "description",
        F.col("quantity").try_cast("double").alias("quantity"),
        "unit",
        F.col("rate").try_cast("double").alias("rate"),
        F.col("amount").try_cast("double").alias("amount"),
    )


def parse_sheets(sheet: DataFrame) -> DataFrame:
    """Bill lines back from a table of sheet texts."""
    split = sheet.where(F.col("line_no") >= PREAMBLE_LINES).select(
        "project_id", F.from_csv("text", _SHEET_ROW, _QUOTING).alias("r")
    )
    return _bill_rows(split.select("project_id", "r.*"))


def read_text_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Bill lines back from written text files."""
    return _bill_rows(spark.read.schema(_SHEET_ROW + ", project_id long").options(**_QUOTING).csv(path))


def workbook(
    lines: DataFrame, purchases: DataFrame, projects: DataFrame, vendors: DataFrame
) -> Mapping[str, DataFrame]:
    """The four sheets of a workbook as tables."""
    summary = trade_summary(lines)
    figures = cost_rollup(project_totals(summary), keep=("trades", "lines"))
    bought = purchases.groupBy("project_id", "vendor_name").agg(
        F.count("*").alias("lines"), from_cents(F.sum(cents(F.col("total")))).alias("total")
    )
    # names may recur; the city is that of the vendor with the least id
    one_per_name = vendors.groupBy(F.col("name").alias("vendor_name")).agg(F.min_by("city", "id").alias("city"))
    return {
        "summary": figures.withColumnRenamed("total", "grand_total"),
        "detailed": lines.join(
            projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left"
        ),
        "materials": materials_summary(lines),
        "vendors": bought.join(one_per_name, "vendor_name", "left"),
    }


def write_workbook(sheets: Mapping[str, DataFrame], path: str) -> None:
    for name, sheet in sheets.items():
        sheet.write.parquet(f"{path}/{name}")
