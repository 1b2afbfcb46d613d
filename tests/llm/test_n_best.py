"""The n best segmentations of DataFrames: pieces, scores and digests of every rank."""

from __future__ import annotations

import hashlib
import resource

import numpy as np

import corpus_pipeline
from tallyspark.llm import pieces, queries

TEXTS = [(1, "the rain in theran is near"), (2, ""), (3, None), (4, "a ▁ b▁"), (5, "é 漢 😀 the"), (None, "ten hats on the nets")]


def test_every_rank_has_its_pieces(spark):
    path = queries.tokenizer_path()
    read = pieces.read_model(path)
    vocabulary = pieces.Vocabulary(*read)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    coded = {r.doc_id: r for r in pieces.encoded(docs, path, n=4).collect()}
    report = {r.doc_id: r for r in pieces.encoding_report(docs, path, n=4).collect()}
    for i, text in TEXTS:
        ranks = [coded[i].pieces, *coded[i].others]
        assert len(ranks) == len(coded[i].scores) == len({tuple(x) for x in ranks}) and list(report[i].scores) == list(coded[i].scores)
        assert all(vocabulary.decode(x) == (text or "") for x in ranks) and all(report[i].all_round_trip)
        assert report[i].all_sha256 == [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in ranks]
        assert (report[i].pieces_sha256, report[i].round_trip) == (report[i].all_sha256[0], report[i].all_round_trip[0])
        assert list(coded[i].scores) == sorted(coded[i].scores, reverse=True)
    for i in (1, None):
        assert len(coded[i].others) == 3
        for x, score in zip([coded[i].pieces, *coded[i].others], coded[i].scores, strict=True):
            assert abs(sum(read[0][k][1] for k in x) - score) < 1e-6
    assert coded[2].others == [] and coded[2].scores == [0.0]


def test_query_digests_every_rank(spark):
    rows = queries.QUERIES["op6_pieces"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.round_trip and r.second_round_trip is not False and r.third_round_trip is not False for r in rows)
    for r in rows:
        ranks = [(r.best_score, r.pieces_sha256), (r.second_score, r.second_sha256), (r.third_score, r.third_sha256)]
        assert all((s is None) == (d is None) for s, d in ranks)
        assert len({d for _, d in ranks if d}) == sum(d is not None for _, d in ranks)


def test_one_unit_of_a_million_characters():
    vocabulary = pieces.Vocabulary(*pieces.read_model(queries.tokenizer_path()))
    text = "".join(np.random.default_rng(5).choice(list("theranionsQ9é漢"), 1_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ranked = pieces.Encoder(vocabulary).ranked(text, 3)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 400_000  # KB
    assert len(ranked) == 3 and all(vocabulary.decode(ids) == text for _, ids in ranked)
    assert ranked[0][0] >= ranked[1][0] >= ranked[2][0] and len({ids.tobytes() for _, ids in ranked}) == 3


def test_equal_letters_in_one_unit():
    vocabulary = pieces.Vocabulary(*pieces.read_model(queries.tokenizer_path()))
    ranked = pieces.Encoder(vocabulary).ranked("x" * 20_000, 3)
    assert len({ids.tobytes() for _, ids in ranked}) == 3 and all(vocabulary.decode(ids) == "x" * 20_000 for _, ids in ranked)


def test_clashing_names(spark):
    path = queries.tokenizer_path()
    names = ["_work", "_Work_", "_text", "`pieces`", "scores", "text"]
    docs = spark.createDataFrame([(1, "a", "b", "c", "d", "e", "the rain")], "doc_id long, " + ", ".join(f"{n} string" for n in names))
    columns = ("doc_id", "_work", "_Work_", "_text", "pieces", "scores")
    coded = pieces.encoded(docs, path, columns)
    assert coded.columns == ["doc_id", "_work", "_Work_", "_text", "pieces", "scores", "n_pieces", "others"]
    back = pieces.decoded(coded, path, ("doc_id", "_work", "_Work_", "_text")).collect()
    assert [tuple(r) for r in back] == [(1, "a", "b", "c", "the rain")]
    assert pieces.encoding_report(docs, path, columns).filter("round_trip").count() == 1


def test_pipeline_gives_the_n_best(spark):
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in TEXTS], "doc_id long, text string, lang string, source string")
    read = pieces.read_model(queries.tokenizer_path())
    vocabulary = pieces.Vocabulary(*read)
    for r in corpus_pipeline.encode(spark, docs, "").collect():
        text = dict(TEXTS)[r.doc_id] or ""
        ranks = [r.pieces, *r.others]
        assert len(ranks) == len(r.scores) == len({tuple(x) for x in ranks}) and r.score == r.scores[0]
        assert all(vocabulary.decode(x) == text for x in ranks) and (len(ranks) == 3 or len(text) < 8)
