"""The registered queries of the folder against their SQL or a plain version, and the pipeline."""

from __future__ import annotations

import collections
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import queries, toxicity
from tallyspark.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
NAMES = "documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return float(f"{value:.12g}") + 0.0 if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in NAMES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in result.collect())
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_native_operators_run_no_python(spark):
    for name in ("op4_url_rules", "op9_source_mix"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_cross_entropy", "op5_metric_join", "op6_pieces", "op8_jaccard_join", "op10_toxicity"])
def test_query_has_a_row_per_input_row(spark, name):
    source = "embeddings" if name.startswith("op5") else "documents"
    result = queries.QUERIES[name](spark, FOLDER)
    assert result.count() == table(spark, FOLDER, source).count()


def test_pipeline_against_a_plain_version(spark):
    from tests.llm.test_edges import brute_jaccard, words

    docs = table(spark, FOLDER, "documents")
    kept = docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, FOLDER), "test-stage")
        results[name] = kept.collect()
        if name != "piece encoding":
            assert kept.columns == docs.columns
    model = toxicity.train(docs, table(spark, FOLDER, "labels"), learn_from=~toxicity.held_out(F.col("doc_id")))
    clean = {r.doc_id for r in toxicity.scores(docs, model).collect() if r.score < 0.7}
    assert {r.doc_id for r in results["toxicity"]} == clean

    best = {}
    for r in results["toxicity"]:
        key = "".join(words(r.text))
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in results["exact dedup"]} == {i for _, i in best.values()}

    texts = [(r.doc_id, r.text) for r in results["exact dedup"]]
    named = {c for _, _, c in brute_jaccard(texts, 5, 80)}
    assert {r.doc_id for r in results["n-gram Jaccard join"]} == named

    before = {r.doc_id: r for r in results["n-gram Jaccard join"]}
    times = collections.Counter(r.doc_id for r in results["source mix"])
    assert all(r == before[r.doc_id] for r in results["source mix"]) and max(times.values()) <= 3

    encoded = collections.Counter(r.doc_id for r in results["piece encoding"])
    assert encoded == times and all(r.n_pieces == len(r.pieces) for r in results["piece encoding"])
