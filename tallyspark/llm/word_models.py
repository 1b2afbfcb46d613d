"""Cross-entropy difference under word n-gram models of target and background, both counted over the whole corpus.

A text is its words (runs of characters that are no ASCII white space, taken as
they are) and an end mark; each is a token. Both models are of order 3 and
matched: the same vocabulary (all different words, the end mark and one symbol
for a word never seen), the same smoothing of each order towards the next lower
one, and background counts scaled to the total of the target's. The target is
the documents marked as such, the background all documents. The score is the mean,
over a text's tokens, of the target model's loss less the background model's, in
bits, so low scores are near the target.

Words, pairs and triples of words are counted as hashes of 56 bits, of which at 10^10
different n-grams one in seven million shares its value; nothing is pruned, so the table of counts grows with the corpus. Documents are dealt into batches and
hashes into ranges, as many of each as the bytes of text ask for. A batch sends every
different n-gram it holds, with its counts, to the range of it, once; a range adds them up and
answers each batch in the order in which it asked, so that the answer needs no
hashes and the batch scores its documents from it. A hot n-gram is at most one entry
a batch. Nothing but the number of bytes passes the driver.

Null and empty texts have one token, their end. Without target documents both
models are uniform. Repeated rows count as often as they occur and are scored alike; rows alike in id and
text share a batch. An id is a target if any of its labels says so, a null id never is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.cross_entropy import WEIGHT
from tallyspark.llm.shared import text_or_empty

BATCH = 8 << 20  # bytes of text in a batch, and whose n-grams are in a range
BITS = 56
ODD = np.uint64(1)  # hashes of single words are odd, of pairs and triples even
START, END = np.uint64(0x9E3779B97F4A7C), np.uint64(0xC2B2AE3D27D4EB)
SENT = "range int, batch int, grams binary, target binary, every binary"
ANSWERED = "range int, batch int, target binary, every binary, words long, target_total long, every_total long"


def squeezed(raw: bytes) -> bytes:
    """Compressed bytes after their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def restored(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes without the empty high ones, compressed; the first byte is how many there are."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + squeezed(np.ascontiguousarray(planes[:width]).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(restored(raw[1:]), np.uint8).reshape(raw[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : raw[0]] = planes.T
    return values.view("<u8").ravel()


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An even hash of two hashes."""
    x = first * np.uint64(0xD6E8FEB86659FD93) + second
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(64 - BITS)) & ~ODD


class _Words(dict):
    """Word → its number in a batch, from 2 on: 0 is the start mark and 1 the end mark."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


class Grams:
    """The n-grams of a batch: their hashes by place, where places are the start mark and the tokens of each text."""

    def __init__(self, texts: list[bytes]):
        number = _Words()
        places: list[int] = []
        begins = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            begins[i] = len(places)
            places.append(0)
            places.extend(map(number.__getitem__, text.split()))
            places.append(1)
        words = np.empty(len(number), object)
        words[:] = list(number)
        own = pd.util.hash_array(words, categorize=False) >> np.uint64(64 - BITS)
        hashes = np.concatenate([np.array([START, END]), own]) | ODD
        del words, number
        one = hashes[np.array(places, np.int64)]
        two = mixed(np.concatenate([hashes[:1], one[:-1]]), one)
        two[begins] = mixed(hashes[:1], hashes[:1])
        self.tokens = np.ones(one.size, bool)
        self.tokens[begins] = False
        three = mixed(two[:-1], one[1:])[self.tokens[1:]]
        self.hashes = (one, two, three)
        self.lengths = np.diff(np.append(begins, one.size))

    def of(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all n-grams of all texts, or of those chosen."""
        if chosen is None:
            return np.concatenate(self.hashes)
        here = np.repeat(chosen, self.lengths)
        one, two, three = self.hashes
        return np.concatenate([one[here], two[here], three[here[self.tokens]]])


def cut_at(grams: np.ndarray, ranges: int) -> list[int]:
    """Where each range begins in sorted hashes, and their end."""
    least = [np.uint64(-(-(k << BITS) // ranges)) for k in range(1, ranges)]
    return [0, *np.searchsorted(grams, np.array(least, np.uint64)).tolist(), grams.size]


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of documents compressed, for their way to the batches."""
    for rows in batches:
        texts = [squeezed(t) for t in rows.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("batch"), pa.array(texts, pa.binary())], ["doc_id", "batch", "text"])


def texts_of(docs: pa.Table) -> list[bytes]:
    return [restored(t) for t in docs.column("text").to_pylist()]


def _asks(ranges: int):
    def ask(docs: pa.Table, marks: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            grams = Grams(texts_of(docs))
            marked = pc.is_in(docs.column("doc_id"), value_set=marks.column("_id").combine_chunks())
            found, every = np.unique(grams.of(), return_counts=True)
            target = np.zeros(found.size, np.int64)
            near, times = np.unique(grams.of(marked.to_numpy()), return_counts=True)
            target[np.searchsorted(found, near)] = times
            ends = cut_at(found, ranges)
            batch = docs.column("batch")[0].as_py()
            for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                rows.append((k, batch, packed(np.diff(found[a:b], prepend=np.uint64(0))), packed(target[a:b]), packed(every[a:b])))
        return _table(rows, SENT)

    return ask


def answer(sent: pa.Table) -> pa.Table:
    """Counts over all batches of the n-grams of a range, for each batch in its own order."""
    grams = [np.cumsum(unpacked(g), dtype=np.uint64) for g in sent.column("grams").to_pylist()]
    found, at = np.unique(np.concatenate(grams), return_inverse=True)
    single = (found & ODD == ODD) & (found != START | ODD)
    added = {}
    for kind in ("target", "every"):
        counts = np.concatenate([unpacked(c) for c in sent.column(kind).to_pylist()])
        added[kind] = np.bincount(at, weights=counts, minlength=found.size).astype(np.int64)
    whole = (int(single.sum()), int(added["target"][single].sum()), int(added["every"][single].sum()))
    ends = np.cumsum([0, *map(len, grams)])
    rows = []
    for i, (k, batch) in enumerate(zip(sent.column("range").to_pylist(), sent.column("batch").to_pylist(), strict=True)):
        own = at[ends[i] : ends[i + 1]]
        rows.append((k, batch, *(packed(added[c][own]) for c in ("target", "every")), *whole))
    return _table(rows, ANSWERED)


def losses(grams: Grams, places: np.ndarray, counts: np.ndarray, total: float, words: int) -> np.ndarray:
    """Bits of each token; `places` are those of the n-grams in `counts`, in the order of `Grams.of`."""
    size = grams.tokens.size
    tokens = np.flatnonzero(grams.tokens)
    one, two, three = counts[places[:size]], counts[places[size : 2 * size]], counts[places[2 * size :]]
    single = (one[tokens] + 1) / (total + words)
    pair = (two[tokens] + WEIGHT * single) / (one[tokens - 1] + WEIGHT)
    triple = (three + WEIGHT * pair) / (two[tokens - 1] + WEIGHT)
    return -np.log2(triple)


def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    answers = answers.sort_by("range")
    columns = {"doc_id": docs.column("doc_id"), "n_tokens": pa.array([], pa.int64())}
    if docs.num_rows:
        words, near_total, far_total = (pc.sum(answers.column(c)).as_py() for c in ("words", "target_total", "every_total"))
        target, every = (
            np.concatenate([unpacked(c) for c in answers.column(kind).to_pylist()]).astype(float)
            for kind in ("target", "every")
        )
        grams = Grams(texts_of(docs))
        _, places = np.unique(grams.of(), return_inverse=True)
        n = grams.lengths - 1
        begins = np.cumsum(n) - n
        means = []
        for counts, scale in ((target, 1.0), (every, near_total / max(1, far_total))):
            bits = losses(grams, places, counts * scale, near_total, words + 1)
            means.append(np.add.reduceat(bits, begins) / n)
        near, far = means
        columns["n_tokens"] = pa.array(n, pa.int64())
    else:
        near = far = np.zeros(0)
    return pa.table(columns | {"target_loss": near, "background_loss": far, "score": near - far})


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]
    return pa.Table.from_pylist([dict(zip([n for n, _ in fields], r, strict=True)) for r in rows], schema=pa.schema(fields))


def batched(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with the number of their batch, and how many batches and ranges there are."""
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // BATCH))
    return texts.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")), parts


def counted(docs: DataFrame, small: DataFrame, targets: DataFrame, parts: int) -> DataFrame:
    """Answers to batches: counts of their n-grams in the target and in all documents.

    `docs` and `small` are the documents by batch, with their texts plain and compressed; `targets` holds doc_id."""
    marked = targets.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    marks = docs.join(marked.hint("merge"), F.col("doc_id") == F.col("_id"))
    marks = marks.select(F.col("batch").alias("_batch"), "_id").distinct()
    sent = small.groupBy("batch").cogroup(marks.groupBy("_batch")).applyInArrow(_asks(parts), SENT)
    return sent.groupBy("range").applyInArrow(answer, ANSWERED)


def differences(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score; `targets` holds doc_id."""
    dealt, parts = batched(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = dealt.mapInArrow(squeeze, f"doc_id {kind}, batch int, text binary")
    answers = counted(dealt, small, targets, parts)
    return (
        small.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    )
