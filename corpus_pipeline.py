"""A training-data pipeline over `documents`: toxic texts go, exact and near copies go, sources are mixed, texts encoded.

Every stage takes (spark, docs, folder) and works on all rows its predecessor kept;
all but the last return the columns of `docs`. The last gives the N_BEST best segmentations of
a text: the pieces of the best, the scores of all, and the pieces of the others. The folder gives `labels` to the
first stage. Null and empty texts pass all filters but the copies among them. Rows
with null or repeated ids are rows like others: copies are told by their texts, and
of copies that tie one stays. Texts are read whole, however long; an empty table gives
an empty result; further columns pass all stages but the last, whatever their names.
Texts go to Python in batches of bounded rows and bytes, which the stages set for their session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, jaccard_join, pieces, source_mix, toxicity
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.shared import bounded_batches, stored, table

TOXIC = 0.7
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
N_BEST = 3
CACHED_UNITS = 24_000  # of a task, beside what earlier stages left in its executor


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded_batches(spark)
    model = toxicity.train(docs, table(spark, folder, "labels"), learn_from=~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded_batches(spark)
    return jaccard_join.deduplicate(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return source_mix.mixed_documents(docs, weights=WEIGHTS, max_epochs=MAX_EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded_batches(spark)
    rows = pieces.encoded(docs, tokenizer_path(), ("doc_id", "lang", "source"), n=N_BEST, cached_units=CACHED_UNITS)
    best = F.get("scores", F.lit(0)).alias("score")
    return rows.select("doc_id", "lang", "source", "pieces", "n_pieces", best, "scores", "others")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("piece encoding", encode),
]
ORACLE_SQL = None  # the first, third and last stage are not expressible; tests compare with a plain version


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
