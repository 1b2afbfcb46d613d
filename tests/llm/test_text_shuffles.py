"""The texts of rows that stay are not shuffled: rows that go, or are told apart by others, are few."""

from __future__ import annotations

import pytest

from tallyspark.llm import jaccard_join, source_mix

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def narrow(spark):
    """As for large tables: a table of a row per document is too large for a broadcast, one of a row per source is not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kept", [source_mix.mixed_documents, jaccard_join.deduplicate])
def test_texts_stay_where_they_are(narrow, kept):
    docs = narrow.read.parquet(f"{FOLDER}/documents.parquet")
    result = kept(docs)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "_near_of" not in line]
    assert not joins  # but for the rows of ids that several rows bear
