"""What the pipeline hands Python at once is bounded, and no result depends on where batches end."""

from __future__ import annotations

import pandas as pd
import pytest

import corpus_pipeline
from tallyspark.llm import jaccard_join

FOLDER = "/root/testdata/sf0.001"
KEYS = [f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch")]


@pytest.fixture
def defaults(spark):
    for key in KEYS:
        spark.conf.unset(key)
    yield spark
    for key in KEYS:
        spark.conf.unset(key)


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.encode])
def test_batches_of_a_stage(defaults, stage):
    def sizes(batches):
        for rows in batches:
            yield pd.DataFrame({"n": [len(rows)], "size": [int(rows["text"].str.len().sum())]})

    stage(defaults, defaults.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    for rows, length in ((3000, 10), (3000, 10_000)):
        texts = defaults.range(0, rows, 1, 1).selectExpr(f"repeat('x', {length}) AS text")
        found = texts.mapInPandas(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == rows
        assert max(r["n"] for r in found) <= 1000 and max(r["size"] for r in found) <= (4 << 20) + length


def test_frequent_shingles_whatever_the_batches(defaults):
    # three rows share each text, in unlike batches
    texts = defaults.range(0, 60, 1, 1).selectExpr("concat('shared ', id % 20, ' a b c d') AS text")
    whole = jaccard_join._frequent(texts, 5)
    defaults.conf.set(KEYS[0], "20")
    assert len(whole) and jaccard_join._frequent(texts, 5).tolist() == whole.tolist()
