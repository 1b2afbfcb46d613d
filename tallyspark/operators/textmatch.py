"""Matching short patterns against texts by equi-joins.

`contains` and `starts with` conditions would run as nested-loop joins. Here
both sides are reduced to different values first, and a shared piece of text
makes the match an ordinary hash-partitioned join with the full condition as a
residual filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column) -> Column:
    def of(n: int) -> Column:
        last = F.length(text) - F.lit(n - 1)
        return F.when(
            last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def _key_grams(pattern: Column) -> Column:
    n = F.least(F.length(pattern), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length(pattern) - n + F.lit(1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(pattern, i, n)))


def contains_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) for every different text that contains a non-empty pattern.

    Each pattern is looked up by its rarest piece of up to three characters, so
    a piece that most texts share does not gather them all in one task.
    """
    text = texts.select("text").where(F.col("text").isNotNull()).distinct()
    pattern = patterns.select("pattern").where(F.length("pattern") > 0).distinct()
    pieces = text.select("text", F.explode(_grams(F.col("text"))).alias("gram"))
    # the planner takes exploded rows for far fewer than they are; never broadcast them
    counts = pieces.groupBy("gram").agg(F.count("*").alias("n")).hint("merge")
    wanted = pattern.select("pattern", F.explode(_key_grams(F.col("pattern"))).alias("gram"))
    keyed = (
        wanted.join(counts, "gram", "left")
        .groupBy("pattern")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    return (
        pieces.hint("merge").join(keyed, "gram")
        .where(F.contains("text", F.col("pattern")))
        .select("text", "pattern")
    )


def prefixes(text: Column) -> Column:
    """All non-empty prefixes of a text, the text itself included."""
    return F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n)),
    ).otherwise(F.array().cast("array<string>"))
