"""Exact deduplication: equal texts by a 128-bit content hash, with the bytes compared inside each group.

Two texts are equal when they are identical after the deletion of white space.
The hash is MD5 of that normalised text. Rows are grouped by hash and bytes: the
hash deals them out, and the comparison of bytes inside each hash keeps texts
apart that collide. Both groupings are reduced before the shuffle, so of a text
that a third of all rows share one row a task is moved. A document then finds its
group by MD5 and SHA-256 of its text; should two texts share both, the job stops
with an error.

Null texts count as empty, and empty texts form a group of their own. Of equal
texts, the one with the most code points in its original form stays, of those
the smallest id, ids before null. Rows that share id and text are reported
alike; `deduplicate` keeps one of them. An empty table gives an empty result.
Further columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import SPACE, stored, text_or_empty, unused


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    plain = F.regexp_replace("original", SPACE, "")
    return docs.select(
        F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("original")
    ).select(
        "doc_id",
        F.length("original").alias("n_points"),
        plain.alias("plain"),
        F.unhex(F.md5(plain)).alias("content"),
    )


def groups_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    texts = _texts(docs, id_column, text_column)
    rows = stored(
        texts.select("doc_id", "n_points", "content", F.sha2("plain", 256).alias("text_sha256")), "exact-rows"
    )
    # equal bytes meet here, copies of a text within a task as one row; the hash only deals them out
    different = texts.groupBy("content", "plain").agg(F.count("*").alias("n"))
    sizes = (
        different.groupBy("content", F.sha2("plain", 256).alias("text_sha256"))
        .agg(F.sum("n").alias("group_size"), F.count("*").alias("n_texts"))
        .select(
            "content",
            "text_sha256",
            F.when(F.col("n_texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long"))
            .alias("group_size"),
        )
    )
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    keepers = rows.groupBy("content", "text_sha256").agg(best.alias("best"))
    groups = stored(keepers.join(sizes, ["content", "text_sha256"]), "exact-groups")
    return rows.join(groups, ["content", "text_sha256"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        "text_sha256",
        "n_points",
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group, with their own columns."""
    keep_id, keep_text, keep_points, keep_rows = (
        unused(docs.columns, f"_keep_{c}") for c in ("id", "text", "points", "rows")
    )
    keep = (
        groups_of(docs, id_column, text_column)
        .filter("kept")
        .groupBy(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_text))
        .agg(F.max("n_points").alias(keep_points), F.count("*").alias(keep_rows))
    )
    text = text_or_empty(text_column)
    # The rows that stay are found by id; the content tells rows apart that share an id.
    found = docs.join(
        keep,
        F.col(id_column).eqNullSafe(F.col(keep_id))
        & (F.length(text) == F.col(keep_points))
        & (F.sha2(F.regexp_replace(text, SPACE, ""), 256) == F.col(keep_text)),
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = found.filter(F.col(keep_rows) == 1).select(*columns)
    repeated = found.filter(F.col(keep_rows) > 1).dropDuplicates([keep_id, keep_text]).select(*columns)
    return single.unionByName(repeated)
