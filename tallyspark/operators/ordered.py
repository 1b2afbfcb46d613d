"""Running totals and neighbours within a key, safe for a hot key.

A plain window puts all rows of a key into one task. Here the rows of a key are
cut into blocks by a column that never decreases along the order (an id range,
a day): the window runs within (key, block), one small row per block carries
the total or the last value over, and the two are joined on (key, block).
Results equal those of the plain window. Null keys and null blocks are values
like others; a null block comes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_block(column: str, width: int = 1_000_000) -> Column:
    """The first id of the range of `width` ids a row is in."""
    return (F.col(column) - F.pmod(F.col(column), F.lit(width))).cast("long")


def time_block(column: str, seconds: int = 86_400) -> Column:
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / F.lit(seconds)).cast("long")


def fitting_width(df: DataFrame, value: Column, rows: int = 1_000_000) -> int:
    """Width of value ranges that hold about `rows` rows of the whole table each.

    One aggregate over the column; a key can then never bring much more than
    `rows` rows into a block, unless rows crowd at single values.
    """
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return 1
    return max(1, int((high - low + 1) * rows // n))


def fitting_time_block(df: DataFrame, column: str, seconds: int | None = None) -> Column:
    """Time blocks of the given length, or of a length that fits the table."""
    if seconds is None:
        seconds = fitting_width(df, F.unix_seconds(F.col(column).cast("timestamp")))
    return time_block(column, seconds)


def _blocked(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Rows with their block and `_at`, key and block as one value, which is never null itself.

    Windows, sums and the join all go by `_at`, so rows are shuffled once for the three.
    """
    return df.withColumn("_block", block).withColumn("_at", F.struct(*keys, "_block"))


def _by_block(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sums.select("*", *[F.col("_at")[c].alias(c) for c in [*keys, "_block"]])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    totals: Mapping[str, Column],
    whole: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key; rows of a key need a total order.

    With `whole`, the sum over all rows of the key is added as `<name>_whole`.
    """
    keys = list(keys)
    blocked = _blocked(df, keys, block)
    within = Window.partitionBy("_at").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocked.groupBy("_at").agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
    carried = _by_block(sums, keys).select(
        "_at",
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in totals],
        *[F.sum(f"_sum_{name}").over(every).alias(f"{name}_whole") for name in totals if whole],
    )
    local = blocked.withColumns({name: F.sum(value).over(within) for name, value in totals.items()})
    joined = local.join(carried, "_at")
    return joined.select(
        *df.columns,
        *[(F.col(name) + F.col(f"_before_{name}")).alias(name) for name in totals],
        *[f"{name}_whole" for name in totals if whole],
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str
) -> DataFrame:
    """row_number() per key."""
    return running_totals(df, keys, order, block, {name: F.lit(1).cast("long")})


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    previous: Mapping[str, str] = {},
    following: Mapping[str, str] = {},
) -> DataFrame:
    """Add values of the row before (lag) and the row after (lead) under new names.

    `order` lists ascending columns that order the rows of a key totally;
    `previous` and `following` map columns to the names of their shifted values.
    """
    keys = list(keys)
    blocked = _blocked(df, keys, block)
    within = Window.partitionBy("_at").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_block")
    moment = F.struct(*order)
    sides = {
        side: (F.struct(*[F.col(c) for c in names]), shift, edge, names)
        for side, names, shift, edge in (
            ("before", previous, F.lag, F.max_by),
            ("after", following, F.lead, F.min_by),
        )
        if names
    }
    edges = blocked.groupBy("_at").agg(
        *[edge(packed, moment).alias(f"_edge_{side}") for side, (packed, _, edge, _) in sides.items()]
    )
    carried = _by_block(edges, keys).select(
        "_at",
        *[shift(f"_edge_{side}").over(across).alias(f"_carried_{side}") for side, (_, shift, _, _) in sides.items()],
    )
    local = blocked.withColumns(
        {f"_near_{side}": shift(packed).over(within) for side, (packed, shift, _, _) in sides.items()}
    )
    joined = local.join(carried, "_at")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(f"_near_{side}", f"_carried_{side}").getField(column).alias(name)
            for side, (_, _, _, names) in sides.items()
            for column, name in names.items()
        ],
    )
