"""The word n-gram models of op2 against a plain recomputation, in one batch and in many."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries, word_models
from tallyspark.llm.shared import table

FOLDER = "/root/testdata/sf0.001"


def plain(texts, marked):
    """Rows (id, tokens, target loss, background loss) by counting tuples of words."""
    docs = [(i, ("<s>", "<s>", *re.findall(r"[^\x20\x09-\x0D]+", t or ""), "</s>")) for i, t in texts]
    target, every = collections.Counter(), collections.Counter()
    for i, w in docs:
        for counts in (every, target) if i is not None and i in marked else (every,):
            for k in range(2, len(w)):
                for grams in (("t", w[k]), ("t", w[k - 1], w[k]), ("t", *w[k - 2 : k + 1]), ("c", w[k - 1]), ("c", *w[k - 2 : k]), "all"):
                    counts[grams] += 1
    words = len({w for _, d in docs for w in d[2:]}) + 1
    share = target["all"] / max(1, every["all"])

    def loss(counts, scale, a, b, c):
        p = (counts["t", c] * scale + 1) / (counts["all"] * scale + words)
        p = (counts["t", b, c] * scale + 4 * p) / (counts["c", b] * scale + 4)
        return -np.log2((counts["t", a, b, c] * scale + 4 * p) / (counts["c", a, b] * scale + 4))

    for i, w in docs:
        both = [np.mean([loss(m, s, *w[k - 2 : k + 1]) for k in range(2, len(w))]) for m, s in ((target, 1.0), (every, share))]
        yield i, len(w) - 2, *both, both[0] - both[1]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6), round(r[3], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)


@pytest.mark.parametrize("size", [1 << 24, 40])
def test_word_models_of_edges(spark, monkeypatch, size):
    monkeypatch.setattr(word_models, "BATCH", size)
    texts = [(1, "a b a b c"), (2, "a  b\n\tc"), (3, None), (4, ""), (5, " \n"), (6, "é 漢字 \x00 a b"), (7, "c b a"), (7, "c b a")]
    texts += [(None, "a b"), (None, "x y z"), ((1 << 60) + 1, "a b c d"), (8, "w " * 300), (9, "a b c " * 50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(1,), (1,), (7,), (None,), (77,), ((1 << 60) + 1,)], "doc_id long")
    same(word_models.differences(docs, labels).collect(), plain(texts, {1, 7, (1 << 60) + 1}))
    unmarked = word_models.differences(docs, labels.limit(0)).collect()
    assert len(unmarked) == len(texts) and all(abs(r.score) < 1e-12 for r in unmarked)
    assert word_models.differences(docs.limit(0), labels).count() == 0


def test_query_tells_word_order(spark):
    docs = [(i, "red green blue") for i in range(20)] + [(i, "blue green red") for i in range(20, 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in word_models.differences(frame, frame.filter("doc_id < 10")).collect()}
    assert scores[15] < scores[25]


def test_query_counts_words_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(word_models, "BATCH", 1 << 16)
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels").filter("quality = 1")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    same(queries.QUERIES["op2_cross_entropy"](spark, FOLDER).collect(), plain(texts, {r.doc_id for r in labels.collect()}))
    dealt, parts = word_models.batched(docs)
    assert parts > 1
    small = dealt.mapInArrow(word_models.squeeze, "doc_id long, batch int, text binary")
    grams = word_models.counted(dealt, small, labels, parts).select("range", "words").distinct().agg(F.sum("words")).first()[0]
    assert grams == len({w for _, t in texts for w in (t or "").encode().split()}) + 1
