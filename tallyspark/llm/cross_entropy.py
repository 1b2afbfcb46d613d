"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both are n-gram models of order 3 over bytes and share one vocabulary: the byte
values that occur in any document, the end mark, and one symbol for a value that
occurs in none. They are matched: the same order, the same smoothing of each
order towards the next lower one, and background counts scaled to the total of
the target's. The target is the documents marked as such; the background is all
documents. Each byte and the end of a text is a token; the score is the mean,
over a text's tokens, of the target model's loss less the background model's, in
bits, so low scores are near the target.

Counts are taken over every byte of all documents, in numpy within the tasks and
by a reduced shuffle between them, and their exchange grows with the input. What
meets on the driver are the counts of different trigrams: at most 256^3 rows,
however large the corpus, and a few ten thousand for texts in four languages.
The loss tables sent to the tasks have one number per trigram of the vocabulary,
which bounds them in the same way.

Null and empty texts have one token, their end. A byte of value 0 counts as an
end mark within a text. Without target documents the target model knows nothing
and is uniform. Repeated rows count as often as they occur and are scored alike;
an id is a target if any of its labels says so, a null id never is.

This table of bytes soon stops growing; op2 scores with the word n-grams of `word_models`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import rows_of, text_or_empty

WEIGHT = 4.0  # of the lower order, in tokens


def framed(text: str) -> np.ndarray:
    """The bytes of a text between two start marks and an end mark, all of value 0."""
    return np.frombuffer(b"\0\0" + text.encode("utf-8", "surrogatepass") + b"\0", np.uint8)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in rows_of(batches, 1000):
        for target, part in rows.groupby("target"):
            found = []
            for text in part["text"]:
                b = framed(text).astype(np.int32)
                found.append((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"code": codes, "target": counts * bool(target), "every": counts})


def counted(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Trigrams as numbers with their counts in the target and in all documents; `targets` holds doc_id."""
    marked = targets.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col("doc_id").alias("_doc"), text_or_empty("text").alias("text"))
    # always a merge join: the marked ids grow with the corpus, and a broadcast of the few of a small one says nothing
    flagged = texts.join(marked.hint("merge"), F.col("_doc") == F.col("_id"), "left").select(
        "text", F.col("_id").isNotNull().alias("target")
    )
    return (
        flagged.mapInPandas(_count, "code int, target long, every long")
        .groupBy("code")
        .agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
    )


def losses(counts: np.ndarray) -> np.ndarray:
    """Bits of each third symbol after the first two, from counts by symbols (a cube)."""
    size = counts.shape[0]
    ones = counts.sum(axis=(0, 1))
    single = (ones + 1) / (ones.sum() + size)
    twos = counts.sum(axis=0)
    pair = (twos + WEIGHT * single) / (twos.sum(axis=1, keepdims=True) + WEIGHT)
    triple = (counts + WEIGHT * pair) / (counts.sum(axis=2, keepdims=True) + WEIGHT)
    return -np.log2(triple)


class Models:
    """The symbol of each byte value, and the losses of both models by trigram of symbols."""

    def __init__(self, code: np.ndarray, target: np.ndarray, every: np.ndarray):
        code = np.asarray(code, dtype=np.int64)
        parts = np.stack([code >> 16, (code >> 8) & 255, code & 255]) if code.size else np.zeros((3, 0), np.int64)
        known = np.union1d(np.unique(parts), [0])
        self.size = known.size + 1  # the last symbol is for values never seen
        self.symbol = np.full(256, known.size, dtype=np.int64)
        self.symbol[known] = np.arange(known.size)
        places = tuple(self.symbol[p] for p in parts)
        share = np.sum(target) / max(1, np.sum(every))
        self.tables = []
        for counts in (np.asarray(target, float), np.asarray(every, float) * share):
            cube = np.zeros((self.size,) * 3)
            cube[places] = counts
            self.tables.append(losses(cube).ravel())


def fit(docs: DataFrame, targets: DataFrame) -> Models:
    counts = counted(docs, targets).toPandas().sort_values("code")
    return Models(counts["code"].to_numpy(), counts["target"].to_numpy(), counts["every"].to_numpy())


def differences(docs: DataFrame, models: Models) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score."""
    sent = docs.sparkSession.sparkContext.broadcast((models.symbol, models.size, *models.tables))
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, size, target, background = sent.value
        for rows in rows_of(batches, 1000):
            found = []
            for text in rows["text"]:
                s = symbol[framed(text)]
                places = (s[:-2] * size + s[1:-1]) * size + s[2:]
                found.append((places.size, target[places].mean(), background[places].mean()))
            n, near, far = (np.array(x) for x in zip(*found, strict=True)) if found else ([], np.array([]), np.array([]))
            yield pd.DataFrame(
                {"doc_id": rows["doc_id"], "n_tokens": n, "target_loss": near, "background_loss": far, "score": near - far}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(
        score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    )
