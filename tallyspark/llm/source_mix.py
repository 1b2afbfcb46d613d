"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated `max_epochs` times at most. The
wanted total is shared by weight; a source whose share is above its cap gets the
cap, and the rest is shared anew by weight until no share is above its cap. Of
sources ordered by cap over weight the first ones are capped, so the level is
found from running sums over the table of sources, all in whole numbers; the
fraction of a target is only made by its one last division.

Each document is taken floor(target / source size) times, and a seeded fraction
of the documents once more: in the order of a hash of seed and id until the
rest of the target is reached. The last of them is taken in part, so a source
comes within a word of its target. Where that order is cut is found from sums
over 4096 ranges of the hash, then over 4096 ranges within the range of the cut;
only documents of the last such range, a part in 16 million, are numbered.
A rerun gives the same rows; no document passes `max_epochs` times its size.

Sizes are word counts; null and empty texts have size 0 and are taken 0 words.
A null source is a source, ordered last. An empty source, or one whose documents
are all empty, has target 0. Rows that share an id are ordered by size. Only
DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import WORD, small, stored, text_or_empty, unused

DIGITS = 3  # hexadecimal digits of a range: 4096 ranges a level


def _place(seed: str, id_column: str) -> Column:
    """The hash that orders the documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def sizes_of(docs: DataFrame, seed: str, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """Light rows: doc_id, source, size and the hash that orders the documents."""
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("long").alias("size"),
        _place(seed, id_column).alias("place"),
    )


def repeating(weights: Sequence[int]) -> Column:
    """The weight of the `rank`-th source, the list repeating."""
    values = F.array(*[F.lit(int(w)) for w in weights])
    return F.element_at(values, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")


def targets_of(sizes: DataFrame, weights: Sequence[int], max_epochs: int, total: Column | None = None) -> DataFrame:
    """Per source: source, source_size, weight, target. One row a source is windowed, never a document."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn(
        "rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    ).select("source", "source_size", repeating(weights).alias("weight"))
    caps = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn(
        "wanted", F.sum("source_size").over(every) if total is None else total
    )
    # all sources before this one in the order of cap / weight are capped
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    state = caps.select(
        "*",
        (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    ).withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
    level = state.select(
        "*",
        F.max(F.when(F.col("fits"), F.struct("open", "left"))).over(every).alias("level"),
        F.max(F.col("fits").cast("int"))
        .over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("is_open"),
    )
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open").cast("double")
    return level.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("is_open") == 1, F.greatest(share, F.lit(0.0))).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def _cut(rows: DataFrame, start: int, rest: DataFrame) -> DataFrame:
    """The range of the hash digits from `start` on in which each source's rest runs out."""
    digits = F.substring("place", start, DIGITS)
    sums = rows.groupBy("source", digits.alias("range")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("range")
    running = sums.withColumn("until", F.sum("words").over(order)).join(rest, rest["of"].eqNullSafe(F.col("source")))
    return (
        running.filter(F.col("until") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("range", "until", "words", "rest")).alias("c"))
        .select(
            F.col("source").alias("of"),
            F.col("c.range").alias("range"),
            (F.col("c.rest") - (F.col("c.until") - F.col("c.words"))).alias("rest"),
        )
    )


def _cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source what is taken of it, and the range of the hash where that ends: of, source_size, target, whole, rest, last, cut."""
    plan = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.col("epochs").cast("long").alias("whole"),
        F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("rest"),
    )
    plan = stored(plan, "mix-plan")
    first = stored(_cut(sizes, 1, plan.filter("rest > 0").select("of", "rest")), "mix-first")
    inside = sizes.join(
        first, first["of"].eqNullSafe(sizes["source"]) & (first["range"] == F.substring("place", 1, DIGITS))
    ).select(sizes["*"])
    second = stored(_cut(inside, 1 + DIGITS, first.select("of", "rest")), "mix-second")

    cuts = (
        plan.join(first.select(F.col("of").alias("of1"), F.col("range").alias("cut1")), F.col("of").eqNullSafe(F.col("of1")), "left")
        .join(
            second.select(F.col("of").alias("of2"), F.col("range").alias("cut2"), F.col("rest").alias("last")),
            F.col("of").eqNullSafe(F.col("of2")),
            "left",
        )
        .select(
            "of", "source_size", "target", "whole", "rest", "last", F.concat("cut1", "cut2").alias("cut")
        )
    )
    # stored, its size is known: one row a source is broadcast when small, and no document is shuffled
    return stored(cuts, "mix-cuts")


def _before(rest: Column, cut: Column, place: Column, size: Column) -> Column:
    """Words taken in part of a document that is not in the range of the cut."""
    # rest = source size happens only by rounding up: then there is no cut and all is taken
    taken = F.when(rest <= 0, F.lit(0)).when(cut.isNull() | (F.substring(place, 1, 2 * DIGITS) < cut), size)
    return F.coalesce(taken, F.lit(0)).cast("long")


def _taken(sizes: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of `taken_words`, with `at_cut` for those in the range of the cut."""
    placed = sizes.join(cuts, F.col("of").eqNullSafe(F.col("source")))
    at_cut = F.col("rest").__gt__(0) & F.coalesce(F.substring("place", 1, 2 * DIGITS) == F.col("cut"), F.lit(False))
    names = ["doc_id", "source", "size", "source_size", "target", "whole"]
    before = _before(F.col("rest"), F.col("cut"), F.col("place"), F.col("size"))
    outside = placed.filter(~at_cut).select(*names, before.alias("part"), F.lit(False).alias("at_cut"))
    order = Window.partitionBy("source").orderBy("place", F.col("doc_id").asc_nulls_last(), "size")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    room = F.greatest(F.col("last") - F.coalesce(running, F.lit(0)), F.lit(0))
    edge = placed.filter(at_cut).select(*names, F.least(room, F.col("size")).cast("long").alias("part"), F.lit(True).alias("at_cut"))
    return outside.unionByName(edge).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def taken_words(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, whole, part, taken.

    `whole` repetitions are taken entirely, and `part` words of one more.
    """
    return _taken(sizes, _cuts(sizes, targets)).drop("at_cut")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """The words taken of every document; see `taken_words` for the columns."""
    sizes = stored(sizes_of(docs, seed, id_column, source_column, text_column), "mix-sizes")
    return taken_words(sizes, targets_of(sizes, weights, max_epochs))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of `docs`, repeated as often as they are taken.

    A repetition that is taken in part is a row when that part is at least half
    of the document. Documents without words are taken as often as their source
    is taken whole, once at least. Rows that share id, source and size (null ids
    are such) share what is taken of them in part: each of their texts is taken
    once more for so many of its rows, its seeded hash rounding up or down, and
    of rows alike in text too the repeated one is the least as JSON.
    """
    id_column = settings.get("id_column", "doc_id")
    source_column = settings.get("source_column", "source")
    text_column = settings.get("text_column", "text")
    seed = settings.get("seed", "mix")
    keys = ("id", "source", "size", "times", "part", "rows", "row", "words", "place", "of", "whole", "rest", "cut")
    names = {c: unused(docs.columns, f"_mix_{c}") for c in keys}
    named = {c: F.col(name) for c, name in names.items()}
    size, part, rows = named["size"], named["part"], named["rows"]
    sizes = stored(sizes_of(docs, seed, id_column, source_column, text_column), "mix-sizes")
    cuts = _cuts(sizes, targets_of(sizes, settings.get("weights", (5, 2, 1)), settings.get("max_epochs", 3)))

    def times_of(whole: Column, size: Column, part: Column, alone: Column) -> Column:
        more = F.greatest(whole, F.lit(1))
        return F.when(size == 0, more).otherwise(whole + (alone & (2 * part >= size)).cast("long")).cast("int")

    # only rows in the range of a cut, or that share id, source and size, need what is known of other rows
    taken = (
        _taken(sizes, cuts)
        .groupBy(*[F.col(c).alias(names[k]) for c, k in (("doc_id", "id"), ("source", "source"), ("size", "size"))])
        .agg(F.max("whole").alias("whole"), F.sum("part").alias(names["part"]), F.count("*").alias(names["rows"]), F.max("at_cut").alias("at_cut"))
        .filter((rows > 1) | F.col("at_cut"))
    )
    taken = taken.withColumn(names["times"], times_of(F.col("whole"), size, part, rows == 1)).drop("whole", "at_cut")
    taken = stored(taken, "mix-times")
    words = F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("long")
    same = (
        F.col(f"`{id_column}`").eqNullSafe(F.col(names["id"]))
        & F.col(f"`{source_column}`").eqNullSafe(F.col(names["source"]))
        & (words == size)
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ends = cuts.select(*[F.col(c).alias(names[c]) for c in ("of", "whole", "rest", "cut")])
    placed = docs.withColumns({names["words"]: words, names["place"]: _place(seed, id_column)}).join(
        ends, named["of"].eqNullSafe(F.col(f"`{source_column}`"))
    )
    before = _before(named["rest"], named["cut"], named["place"], named["words"])
    by_itself = times_of(named["whole"], named["words"], before, F.lit(True))
    times = F.when(rows.isNull(), by_itself).otherwise(named["times"])
    found = placed.join(small(taken), same, "left")
    whole = found.select(*columns, F.explode(F.array_repeat(F.lit(0), times)).alias(names["row"])).select(*columns)

    shared = small(taken.filter((rows > 1) & (part > 0)))
    content = F.md5(F.concat(F.lit(seed), text_or_empty(text_column)))
    keys = [F.col(names[c]) for c in ("id", "source", "size", "part", "rows")]
    alike = docs.join(shared, same).groupBy(*keys, content.alias("content")).agg(
        F.count("*").alias("n"), F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row")
    )
    up = F.conv(F.substring("content", 1, 8), 16, 10).cast("double") / float(1 << 32)
    more = F.least(F.col("n"), F.floor(F.col("n") * part / (size * rows) + up)).cast("int")
    again = alike.select("row", F.explode(F.array_repeat(F.lit(0), more)).alias("copy")).select("row.*")
    return whole.unionByName(again)
