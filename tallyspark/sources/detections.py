"""Detections out of free-form responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schema as S

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def array_text(text: Column) -> Column:
    """The bracketed part of a text, looked for inside a code fence if there is one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    has_fence = text.rlike(r"(?s)```.*?```")
    candidate = F.when(has_fence, fenced).otherwise(text)
    return F.nullif(F.regexp_extract(candidate, r"(?s)\[.*\]", 0), F.lit(""))


def parsed_objects(text: Column) -> Column:
    """Elements of the array in a text; null when the bracketed part is not JSON.

    The part is wrapped in one more array, so that anything after its end makes
    the whole invalid instead of being passed over. The text is parsed once per
    row: the check of the outer array happens inside `filter`.
    """
    wrapped = F.concat(F.lit("["), array_text(text), F.lit("]"))
    outer = F.from_json(wrapped, f"array<array<{S.DETECTION}>>", _STRICT)
    single = F.get(F.filter(F.array(outer), lambda a: F.size(a) == 1), F.lit(0))
    return F.get(single, F.lit(0))


def explode_detections(responses: DataFrame, text: str = "response", first: int = 400) -> DataFrame:
    """One row per detection, at most the first `first` positions of each response."""
    rows = responses.select(
        *[c for c in responses.columns if c != text],
        F.posexplode(parsed_objects(F.col(text))).alias("pos", "o"),
    )
    return rows.where((F.col("pos") < first) & F.col("o").isNotNull())
