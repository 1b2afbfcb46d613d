"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word stands for a bag of hashed pieces: itself and its n-grams of 3 to 5 bytes,
with marks at both ends, so a misspelt word shares most of its vectors with the
word meant. Words are runs of letters and digits, lower-cased. The
vectors of all pieces of a window of words are averaged, and a linear layer with
a softmax over clean and toxic follows; vectors and layer are trained together.

Labels are of whole texts, but a long text may be toxic in one sentence. So each
text is cut into windows of `WINDOW` words. At first every window of a toxic
text counts as toxic with a share of the text's weight; in later rounds only its
most toxic window does, and the share `DOUBTFUL` of the toxic texts that the
model finds least toxic is left out, as labels err. Pieces of under `LEAST_TEXTS` sampled
texts keep a zero vector, so that no single text is learnt by heart. A text's score is that of its most toxic window of any
position, put on the scale of probabilities by a logistic fit over texts that the
model had not seen.

Fitting takes a bounded sample of labelled rows, at most `rows_per_class` texts
of each class, the first by a hash of the id; a sampled text longer than
`SAMPLE_WORDS` words gives evenly spaced parts of that length together. Scores
read whole texts. The sample's bound, the table of `BUCKETS` numbers that is
sent to the executors, and the cache of words in a task do not grow with the
data. Ids, labels, languages and sources are not inputs of a score.

Null and empty texts have no window and get the score of a window without any
piece, which is the fitted bias. Without rows of both classes every score is 0.
Rows that repeat are scored alike; labels of an id that is labelled twice count
as toxic if any is; null labels and ids are not learnt from.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import rows_of, text_or_empty

BUCKETS = 1 << 18
DIMENSIONS = 8
SHORTEST, LONGEST = 3, 5
WINDOW = 12
LEAST_TEXTS = 5
DOUBTFUL = 0.15
CLEAN_WEIGHT = 0.6  # blaming a clean text is worse than missing a toxic one
SAMPLE_WORDS = 4096
PART = 64
CACHED_WORDS = 250_000
RUN = 256
WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")


def pieces_of(word: bytes) -> list[int]:
    """Buckets of a word's pieces; a word of over `RUN` bytes counts as several of that length."""
    if len(word) > RUN:
        return [p for i in range(0, len(word), RUN) for p in pieces_of(word[i : i + RUN])]
    marked = b"<" + word + b">"
    n = len(marked)
    found = [zlib.crc32(marked) % BUCKETS]
    for size in range(SHORTEST, LONGEST + 1):
        found += [zlib.crc32(marked[i : i + size]) % BUCKETS for i in range(n - size + 1)]
    return found


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.lower().encode("utf-8", "surrogatepass"))


class Model:
    """What scoring needs: one number per piece, a bias, and the scale of the texts' scores."""

    def __init__(self, pull: np.ndarray, bias: float, scale: float, shift: float, fitted: bool = True):
        self.pull, self.bias, self.scale, self.shift, self.fitted = pull, bias, scale, shift, fitted

    def plain(self) -> tuple:
        return self.pull, self.bias, self.scale, self.shift, self.fitted

    def probability(self, logit: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros_like(logit)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


class Scorer(dict):
    """Word → place in the arrays of sums and counts; emptied when full, so its memory is bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.sums = np.zeros(CACHED_WORDS + 1)
        self.counts = np.zeros(CACHED_WORDS + 1)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        pieces = pieces_of(word)
        if place >= self.sums.size:
            self.sums, self.counts = (np.concatenate([x, np.zeros(x.size)]) for x in (self.sums, self.counts))
        self.sums[place] = self.model.pull[pieces].sum(dtype=np.float64)
        self.counts[place] = len(pieces)
        self[word] = place
        return place

    def logit(self, text: str) -> float:
        words = words_of(text)
        if not words:
            return self.model.bias
        if len(self) > CACHED_WORDS:
            self.clear()
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        sums = np.concatenate([[0.0], np.cumsum(self.sums[places])])
        counts = np.concatenate([[0.0], np.cumsum(self.counts[places])])
        size = min(WINDOW, len(words))
        means = (sums[size:] - sums[:-size]) / (counts[size:] - counts[:-size])
        return float(means.max()) + self.model.bias


def _adam(value: np.ndarray, slope: np.ndarray, state: list, step: int, rate: float) -> None:
    first, second = state
    first += 0.1 * (slope - first)
    second += 0.01 * (slope * slope - second)
    value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)


def _reached(model: Model, texts: list[list[bytes]]) -> np.ndarray:
    scorer = Scorer(model)
    return np.array([scorer.logit(b" ".join(w).decode("utf-8", "replace")) for w in texts])


def fit(texts: list[list[bytes]], toxic: np.ndarray, seed: int = 7, rounds: int = 3, steps: int = 40) -> Model:
    """Train on texts given as words; `toxic` holds 0 or 1 for each.

    The scale comes from texts that a model has not seen: each half of them is scored by
    a model of the other half.
    """
    toxic = np.asarray(toxic, dtype=np.float64)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0, fitted=False)
    reached = np.zeros(len(texts))
    half = np.zeros(len(texts), bool)
    random = np.random.default_rng(seed)
    for label in (0, 1):
        half[random.permutation(np.flatnonzero(toxic == label))[::2]] = True
    for own in (half, ~half):
        learnt = np.flatnonzero(~own)
        if len({*toxic[learnt]}) < 2:
            learnt = np.arange(len(texts))
        model = _train([texts[i] for i in learnt], toxic[learnt], seed, rounds, steps)
        reached[own] = _reached(model, [texts[i] for i in np.flatnonzero(own)])
    model = _train(texts, toxic, seed, rounds, steps)
    sure = (toxic == 0) | (reached >= np.quantile(reached[toxic == 1], DOUBTFUL))
    model.scale, model.shift = _logistic(reached[sure], toxic[sure])
    return model


def _train(texts: list[list[bytes]], toxic: np.ndarray, seed: int, rounds: int, steps: int) -> Model:
    """Vectors and layer, as one number per piece and a bias; the scale is left open."""
    vocabulary: dict[bytes, int] = {}
    texts_with: list[int] = []
    begins, members, owner = [0], array("i"), []
    for i, words in enumerate(texts):
        places = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        texts_with += [0] * (len(vocabulary) - len(texts_with))
        for place in set(places):
            texts_with[place] += 1
        for j in range(0, len(places), WINDOW):
            if part := places[j : j + WINDOW]:
                members.extend(part)
                begins.append(len(members))
                owner.append(i)
    flat, lengths_of = array("i"), []
    for word in vocabulary:
        bag = pieces_of(word)
        flat.extend(bag)
        lengths_of.append(len(bag))
    sizes, pieces = np.array(lengths_of, dtype=np.int64), np.frombuffer(flat, dtype=np.int32)
    used, pieces = np.unique(pieces, return_inverse=True)
    frequent = np.bincount(pieces, weights=np.repeat(texts_with, sizes)) >= LEAST_TEXTS
    members, owner = np.array(members, dtype=np.int64), np.array(owner, dtype=np.int64)
    begins = np.array(begins[:-1], dtype=np.int64)
    lengths = np.diff(np.append(begins, members.size))
    window_of = np.repeat(np.arange(begins.size), lengths)
    counts = np.add.reduceat(sizes[members], begins).astype(np.float64)
    labels = toxic[owner]

    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (used.size, DIMENSIONS)) * frequent[:, None]
    layer = random.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    states = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, layer, bias)]
    of_word = np.repeat(np.arange(sizes.size), sizes)
    counted = frequent[pieces]  # the other pieces have zero vectors and only count in the means
    pieces, of_word = pieces[counted], of_word[counted]

    def logits() -> np.ndarray:
        """Log odds of toxic over clean of each window: its mean vector through the layer."""
        pulls = vectors @ (layer[:, 1] - layer[:, 0])
        words = np.bincount(of_word, weights=pulls[pieces], minlength=sizes.size)
        return np.add.reduceat(words[members], begins) / counts + bias[1] - bias[0]

    per_text = np.bincount(owner, minlength=len(texts)).astype(np.float64)
    weights = 1 / per_text[owner]
    step = 0
    for turn in range(rounds):
        if turn:
            reached = logits()
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, owner, reached)
            # of a toxic text its most toxic window, of a clean one all windows, the worst of them as much as the rest
            worst = reached >= best[owner]
            doubtful = (toxic == 1) & (best < np.quantile(best[toxic == 1], DOUBTFUL))
            weights = np.where(labels == 1, worst & ~doubtful[owner], 0.5 / per_text[owner] + 0.5 * worst)
        balanced = weights / np.where(labels == 1, weights[labels == 1].sum(), weights[labels == 0].sum())
        for _ in range(steps):
            step += 1
            # of a softmax over two classes the errors of both are opposite
            error = (1 / (1 + np.exp(-np.clip(logits(), -30, 30))) - labels) * balanced
            words = np.bincount(members, weights=(error / counts)[window_of], minlength=sizes.size)
            slope = np.bincount(pieces, weights=words[of_word], minlength=used.size)
            both = np.array([-1.0, 1.0])
            slope_layer = np.outer(slope @ vectors, both) + 1e-4 * layer
            _adam(vectors, np.outer(slope, layer @ both) + 1e-5 * vectors, states[0], step, 0.05)
            _adam(layer, slope_layer, states[1], step, 0.05)
            _adam(bias, error.sum() * both, states[2], step, 0.05)

    pull = np.zeros(BUCKETS, np.float32)
    pull[used] = (vectors @ layer) @ np.array([-1.0, 1.0])
    return Model(pull, float(bias[1] - bias[0]), 1.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton's method; clean texts weigh `CLEAN_WEIGHT` in all."""
    middle, spread = x.mean(), x.std() or 1.0
    z = (x - middle) / spread
    weight = np.where(y == 1, (1 - CLEAN_WEIGHT) / max(1, (y == 1).sum()), CLEAN_WEIGHT / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        slope = np.array([(weight * (p - y) * z).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        curve = weight * p * (1 - p)
        bend = np.array([[(curve * z * z).sum() + 1e-3, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-6]])
        da, db = np.linalg.solve(bend, slope)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a / spread), float(b - a * middle / spread)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _sampled_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for text in batch["text"]:
            words = words_of(text)
            if len(words) > SAMPLE_WORDS:
                parts = np.linspace(0, len(words) - PART, SAMPLE_WORDS // PART).astype(int)
                words = [w for i in parts for w in words[i : i + PART]]
            texts.append(b" ".join(words))
        yield pd.DataFrame({"words": texts, "toxic": batch["toxic"]})


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1000, learn_from: Column | None = None) -> Model:
    """Fit on a bounded sample of the labelled rows; `learn_from` is a condition on `doc_id`."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if learn_from is not None:
        known = known.filter(learn_from)
    order = F.md5(F.col("doc_id").cast("string"))
    first = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(rows_per_class) for c in (0, 1)]
    chosen = first[0].unionByName(first[1]).select(F.col("doc_id").alias("chosen_id"), "toxic")
    sample = docs.select("doc_id", text_or_empty("text").alias("text")).join(chosen, F.col("doc_id") == F.col("chosen_id"))
    rows = sample.select("text", "toxic").mapInPandas(_sampled_words, "words binary, toxic int").toPandas()
    rows = rows.assign(words=[bytes(w) for w in rows["words"]]).sort_values(["words", "toxic"])
    known: dict[bytes, bytes] = {}  # one object a word, however often it occurs
    return fit([[known.setdefault(x, x) for x in w.split()] for w in rows["words"]], rows["toxic"].to_numpy())


def scores(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The given columns of `docs` with `score`, 0 to 1, of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())
    kept = docs.select(*[F.col(c) for c in columns], text_or_empty(text_column).alias("_text"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*sent.value))
        for rows in rows_of(batches, 2000):
            logits = np.array([scorer.logit(t) for t in rows["_text"]])
            yield rows.drop(columns="_text").assign(score=scorer.model.probability(logits))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return kept.mapInPandas(score, f"{schema}, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below the limit."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*sent.value))
        for series in texts:
            yield pd.Series(scorer.model.probability(np.array([scorer.logit(t) for t in series])))

    return docs.filter(score(text_or_empty(text_column)) < limit)
