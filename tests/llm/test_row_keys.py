"""Stages that return rows: null and repeated ids, clashing names."""

from __future__ import annotations

import random

from tallyspark.llm import exact_dedup, jaccard_join, source_mix

CLASHING = ("_keep_id", "_Keep_Rows", "_mix_id", "_mix_row", "_near_id", "_near_text", "content", "part", "row", "n")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, *CLASHING) for i, t, s in rows], SCHEMA)


def test_near_copies_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    base, other = " ".join(words), " ".join(f"v{i}" for i in range(30))
    rows = [(None, base + f" tail{i}", "a") for i in range(3)]  # one component without ids
    rows += [(7, other, "a"), (7, other.upper(), "a"), (7, " ".join(f"u{i}" for i in range(20)), "a")]  # two sets
    rows += [(None, other + " end", "a"), (None, None, "a"), (None, " ", "a"), (3, "", "b"), (9, base[::-1], "b"), (9, base[::-1], "c")]
    got = jaccard_join.deduplicate(table_of(spark, rows))
    assert got.columns == table_of(spark, []).columns
    kept = got.select("doc_id", "text").collect()
    assert len(kept) == 7
    assert sum(r.doc_id is None and (r.text or "").startswith("w0 ") for r in kept) == 1
    assert sorted((r.text or "").lower()[:2] for r in kept if r.doc_id == 7) == ["u0", "v0"]
    assert sum(r.doc_id == 9 for r in kept) == 1 and sum(not (r.text or "").strip() for r in kept) == 3
    assert jaccard_join.deduplicate(table_of(spark, [])).count() == 0


def test_exact_copies_with_clashing_names(spark):
    got = exact_dedup.deduplicate(table_of(spark, [(None, "a b", "s"), (None, "ab", "s"), (2, "ab", "s"), (2, "c", "s"), (2, "c", "t")]))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("2", "c"), ("None", "a b")]


def test_mix_of_rows_without_ids(spark):
    def words(rows):
        return sum(len(r.text.split()) for r in rows)

    for alike in (False, True):
        text = (lambda i: "x " * 12) if alike else (lambda i: f"x{i} " * 12)
        rows = [(None, text(i), "a") for i in range(40)] + [(i, "y " * 8, "b") for i in range(30)] + [(None, "", "b"), (None, None, None)]
        docs = table_of(spark, rows)
        targets = {r.source: r.target for r in source_mix.mix(docs).select("source", "target").distinct().collect()}
        got = source_mix.mixed_documents(docs)
        again = sorted((str(r.doc_id), r.text or "", r.source or "") for r in got.collect())
        assert again == sorted((str(r.doc_id), r.text or "", r.source or "") for r in source_mix.mixed_documents(docs).collect())
        for source in "ab":
            taken = words(r for r in got.collect() if r.source == source)
            assert abs(taken - targets[source]) <= (12 if alike else 60)
        assert got.columns == docs.columns and got.filter("source IS NULL").count() == 1
