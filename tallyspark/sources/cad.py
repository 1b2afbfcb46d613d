"""Entities of CAD exchange files, which are texts of alternating code and value lines.

Files are read line by line and split like any text, so a file may be larger
than a task. Lines are counted with `ordered.running_totals`, whose blocks keep
one huge file from ending up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators.ordered import id_block, numbered, running_totals

# Group codes of entity type, text, layer, position, end point and size.
ENTITY, TEXT, NAME, LAYER, X, Y, X2, Y2, SIZE = "0", "1", "2", "8", "10", "20", "11", "21", "40"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 0 in each file.

    Within a split of a file the generated ids rise with the lines, and splits
    are ordered by their start, so both together order the file exactly.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    counted = numbered(raw, ["file"], [F.col("start"), F.col("seq")], F.col("start"), "n")
    return counted.select("file", (F.col("n") - 1).alias("line_no"), "line")


def code_pairs(lines: DataFrame, block_width: int = 1_000_000) -> DataFrame:
    """(file, pair_no, code, value, block) from numbered lines.

    A pair never crosses a block of even width, so each code finds its value as
    the next line within (file, block).
    """
    within = Window.partitionBy("file", "block").orderBy("line_no")
    near = lines.withColumn("block", id_block("line_no", 2 * block_width)).select(
        "file",
        "block",
        "line_no",
        F.trim("line").alias("code"),
        F.lead("line").over(within).alias("value"),
        F.lead("line_no").over(within).alias("value_no"),
    )
    return near.where(F.col("line_no") % 2 == 0).select(
        "file",
        F.floor(F.col("line_no") / 2).cast("long").alias("pair_no"),
        "code",
        F.when(F.col("value_no") == F.col("line_no") + 1, F.rtrim("value")).alias("value"),
        "block",
    )


def entities(lines: DataFrame, block_width: int = 1_000_000) -> DataFrame:
    """One row per entity, table entry or object of each file.

    A running count of the code that opens an entity numbers the pairs; it runs
    in the blocks the pairs were made in.
    """
    opens = (F.col("code") == ENTITY).cast("long")
    counted = running_totals(
        code_pairs(lines, block_width), ["file"], [F.col("pair_no")], F.col("block"), {"entity_no": opens}
    )

    def first(code: str) -> Column:
        return F.min_by(
            F.when(F.col("code") == code, F.col("value")), F.when(F.col("code") == code, F.col("pair_no"))
        )

    def number(code: str) -> Column:
        return first(code).try_cast("double")

    return (
        counted.where(F.col("entity_no") > 0)
        .groupBy("file", "entity_no")
        .agg(
            first(ENTITY).alias("entity"),
            first(LAYER).alias("layer"),
            first(TEXT).alias("text"),
            first(NAME).alias("name"),
            number(X).alias("x"),
            number(Y).alias("y"),
            number(X2).alias("x2"),
            number(Y2).alias("y2"),
            number(SIZE).alias("size"),
        )
        .where(~F.col("entity").isin("SECTION", "ENDSEC", "EOF", "TABLE", "ENDTAB"))
    )


def drawn(found: DataFrame) -> DataFrame:
    """Entities that are drawn: those of a kind that stands in a plan."""
    return found.where(F.col("entity").isin("LINE", "ARC", "CIRCLE", "INSERT", "TEXT", "MTEXT", "LWPOLYLINE", "POLYLINE"))


def layer_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("file", "layer", "entity").agg(F.count("*").alias("entities"))


def extents(found: DataFrame) -> DataFrame:
    """Bounding box of the drawn points of each file."""
    return found.groupBy("file").agg(
        F.min(F.least("x", "x2")).alias("min_x"),
        F.min(F.least("y", "y2")).alias("min_y"),
        F.max(F.greatest("x", "x2")).alias("max_x"),
        F.max(F.greatest("y", "y2")).alias("max_y"),
    )
