"""Removal of long repeated strings by longest-previous-factor arrays, as a distributed job.

A byte goes when it lies in a string of `length` bytes that also starts elsewhere
in the corpus; matches never cross documents, and strings are judged on the
input. With `keep_first` only later copies go: the starts whose longest previous
factor, the longest match with an earlier start, has `length` bytes or more. The
first copy, that of the least id, text hash and offset, stays. Without it all
copies go; an earlier copy is then the source that such a factor points at.

Sorting every suffix of a corpus is not needed to find matches of one length or
more. Each window of `length` bytes has an anchor, the K-gram of least hash in it;
equal windows have equal anchors at equal places. So

1. anchors of all documents are found in numpy (about two per `length` bytes), with
   a digest of their context, all bytes that a window over the anchor can have;
2. anchors that occur once are dropped by counts of their hash; contexts that occur
   several times are repeated whole, whatever stands around them;
3. anchors with unlike contexts get one copy of each from the texts. In groups of
   one anchor, the suffixes that start at one distance from it are sorted by
   induction: the order at a place follows from its byte and the order one place
   on. Where neighbours in suffix order agree in `length` bytes, compared byte by
   byte, the previous and next smaller positions in that order give earlier
   matches: the longest previous factor;
4. what is repeated around an anchor is one run of bytes, and the runs of a
   document are merged and cut out.

Copies of a document or of a passage have equal contexts and are counted, not
gathered. An anchor with more than `GROUP` unlike contexts, such as the border of
a passage that many documents share, is not brought into one task: its windows
are compared by a digest of 64 bits, beside anchor and distance, in a reduced
count. Both ways give the same rows. Documents without a repeated anchor are not
moved a second time.

Null texts are empty; texts of fewer than `length` bytes keep everything. Very
long texts are worked through in chunks. Rows may repeat: equal rows count as
copies of each other and all get the same result. Ids may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import rows_of, small, stored, text_or_empty

GROUP = 8192
BUCKET = 8192
CHUNK = 1 << 18
PLACE_BITS = 20
FACTOR = 0x9E3779B97F4A7C15 | 1
KEY = ["did", "key"]


def gram_of(length: int) -> int:
    return max(1, length // 5)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash factor and of its inverse, modulo 2^64."""
    inverse = pow(FACTOR, -1, 1 << 64)
    out = []
    for factor in (FACTOR, inverse):
        p = np.full(n, factor, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def byte_values() -> np.ndarray:
    return np.random.default_rng(200).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all windows of a size, from prefix sums."""

    def __init__(self, most: int):
        self.up, self.down = powers(most + 1)
        self.values = byte_values()

    def of(self, raw: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: raw.size], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * self.down[: raw.size - size + 1])


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """The places, ascending, that are the leftmost least of some `span` neighbouring hashes."""
    places = np.arange(hashes.size, dtype=np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~mask) | places
    rows = -(-keys.size // span)
    grid = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    grid[: keys.size] = keys
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = keys.size - span + 1
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    found = (least & mask).astype(np.int64)
    return found[np.append(True, found[1:] != found[:-1])]


def anchors(raw: bytes, length: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the anchors of a text of `length` bytes or more."""
    gram = gram_of(length)
    span = length - gram + 1
    data = np.frombuffer(raw, np.uint8)
    at, values = [], []
    for begin in range(0, data.size - length + 1, CHUNK):
        own = hashes.of(data[begin : begin + CHUNK + length - 1], gram)
        places = least_places(own, span)
        at.append(places + begin)
        values.append(own[places])
    at, values = np.concatenate(at), np.concatenate(values)
    at, first = np.unique(at, return_index=True)
    return at, values[first].view(np.int64)


def _anchor_rows(length: int):
    gram = gram_of(length)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes(CHUNK + length)
        digest = xxhash.xxh3_64_intdigest
        for rows in rows_of(batches, 500):
            out = []
            for did, key, rid, raw in zip(rows["did"], rows["key"], rows["rid"], rows["raw"], strict=True):
                if len(raw) < length:
                    continue
                at, values = anchors(raw, length, hashes)
                left = np.minimum(at, length - gram)
                right = np.minimum(length, len(raw) - at)
                contexts = [
                    digest(raw[a - x : a + y], x) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)
                ]
                out.append(
                    pd.DataFrame(
                        {
                            "did": did, "key": key, "rid": rid, "pos": at, "ahead": right,
                            "anchor": values, "context": np.array(contexts, np.uint64).view(np.int64),
                        }
                    )
                )
            if out:
                yield pd.concat(out)

    return find


ANCHOR_ROWS = "did long, key long, rid long, pos int, ahead int, anchor long, context long"


def smaller_before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it, in its run, with a smaller value; -1 without one.

    `first` is true where a run begins. Pointers jump over larger values until all rest.
    """
    n = values.size
    begins = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    found = np.where(first, -1, np.arange(n) - 1)
    open_ = np.flatnonzero(found >= 0)
    while open_.size:
        open_ = open_[values[found[open_]] > values[open_]]
        found[open_] = found[found[open_]]
        found[open_] = np.where(found[open_] < begins[open_], -1, found[open_])
        open_ = open_[found[open_] >= 0]
    return found


def factor_sources(position: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next smaller positions of entries in suffix order; runs share the length that counts."""
    before = smaller_before(position, first)
    last = np.append(first[1:], True)
    after = smaller_before(position[::-1], last[::-1])[::-1]
    return before, np.where(after >= 0, position.size - 1 - after, -1)


def group_reach(anchor: np.ndarray, contexts: list[bytes], back: np.ndarray, length: int) -> np.ndarray:
    """How far unlike contexts of anchors are repeated.

    Contexts come in the order of their positions in the corpus. Columns of the result:
    first and last repeated start relative to the anchor, then the same of later copies
    only; a first above its last means none.
    """
    size, gram = len(contexts), gram_of(length)
    zero = length - gram  # the column of the anchor
    width = zero + length
    grid = np.zeros((size, width), np.uint8)
    ends = np.zeros(size, np.int64)
    for i, (raw, left) in enumerate(zip(contexts, back, strict=True)):
        grid[i, zero - left : zero - left + len(raw)] = np.frombuffer(raw, np.uint8)
        ends[i] = zero - left + len(raw)
    hashes = np.zeros((size, width + 1), np.uint64)
    up, down = powers(width + 1)
    np.cumsum(byte_values()[grid] * up[:width], axis=1, out=hashes[:, 1:])

    none = 1 << 30
    reach = np.tile(np.array([none, -none, none, -none], np.int64), (size, 1))
    groups = np.unique(anchor, return_inverse=True)[1].astype(np.uint16 if size < 1 << 16 else np.int64)
    # suffixes from the anchor on; before it the order at a column follows from its bytes and the order one column on
    order = np.array(sorted(range(size), key=lambda i: (groups[i], contexts[i][back[i] :])), dtype=np.int64)
    for column in range(zero, -1, -1):
        if column < zero:
            order = order[np.argsort(grid[order, column], kind="stable")]
            order = order[np.argsort(groups[order], kind="stable")]
        rows = order[(column >= zero - back[order]) & (column + length <= ends[order])]
        if rows.size < 2:
            continue
        windows = (hashes[rows, column + length] - hashes[rows, column]) * down[column]
        pairs = np.flatnonzero((windows[1:] == windows[:-1]) & (groups[rows[1:]] == groups[rows[:-1]]))
        same = (grid[rows[pairs], column : column + length] == grid[rows[pairs + 1], column : column + length]).all(axis=1)
        alike = np.zeros(rows.size - 1, bool)
        alike[pairs] = same
        # only suffixes that agree with a neighbour in the length or more can have such a factor
        inside = np.append(alike, False) | np.append(False, alike)
        first = np.append(True, ~alike)[inside]
        rows = rows[inside]
        if not rows.size:
            continue
        before, after = factor_sources(rows, first)  # contexts come in the order of positions
        later = (before >= 0) | (after >= 0)  # the longest previous factor has the length or more
        repeated = later.copy()
        repeated[before[before >= 0]] = True
        repeated[after[after >= 0]] = True
        for flags, at in ((repeated, 0), (later, 2)):
            hit = rows[flags]
            reach[hit, at] = column - zero
            reach[hit, at + 1] = np.maximum(reach[hit, at + 1], column - zero)
    return reach


REACH = "anchor long, context long, lo int, hi int, later_lo int, later_hi int"


def _bucket_reach(length: int):
    def reach(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "context"]).sort_values(["did", "rid", "pos"])
        found = group_reach(rows["anchor"].to_numpy(), list(rows["raw"]), rows["back"].to_numpy(), length)
        out = pd.DataFrame(found, columns=["lo", "hi", "later_lo", "later_hi"], dtype=np.int64)
        return pd.concat([rows[["anchor", "context"]].reset_index(drop=True), out], axis=1)

    return reach


def _windows(length: int):
    zero = length - gram_of(length)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes(2 * length)
        for rows in rows_of(batches, 200):
            out = []
            for row in rows.itertuples(index=False):
                values = hashes.of(np.frombuffer(row.raw, np.uint8), length)
                out.append(
                    pd.DataFrame(
                        {
                            "anchor": row.anchor, "context": row.context, "did": row.did, "rid": row.rid, "pos": row.pos,
                            "start": np.arange(values.size) - row.back, "window": values.view(np.int64),
                        }
                    )
                )
            yield pd.concat(out)

    assert zero >= 0
    return windows


def _hot_reach(contexts: DataFrame, length: int) -> DataFrame:
    """The reach of contexts of anchors with many of them, by counts of equal windows."""
    rows = contexts.mapInPandas(
        _windows(length), "anchor long, context long, did long, rid long, pos int, start int, window long"
    )
    place = F.struct("did", "rid", "pos")
    classes = (
        rows.groupBy("anchor", "start", "window")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
    )
    later = F.when(F.col("first") != place, F.col("start"))
    return (
        rows.join(classes, ["anchor", "start", "window"])
        .groupBy("anchor", "context")
        .agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.min(later).alias("later_lo"), F.max(later).alias("later_hi"))
        .select(
            "anchor", "context", "lo", "hi", F.coalesce("later_lo", F.lit(0)).alias("later_lo"), F.coalesce("later_hi", F.lit(-1)).alias("later_hi")
        )
    )


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents by id and a hash of the text; rows that share both are alike."""
    raw = F.encode(text_or_empty(text_column), "UTF-8")
    return docs.select(F.col(id_column).alias("doc_id"), raw.alias("raw")).select(
        "doc_id", "raw", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"), F.xxhash64("raw").alias("key")
    )


def _repeated(keyed: DataFrame, length: int, keep_first: bool, group: int) -> tuple[DataFrame, DataFrame]:
    """Texts that lose bytes (did, key, raw), and the runs of their bytes that go (did, key, runs)."""
    found = stored(
        keyed.select("did", "key", F.monotonically_increasing_id().alias("rid"), "raw").mapInPandas(
            _anchor_rows(length), ANCHOR_ROWS
        ),
        "suffix-anchors",
    )
    several = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    several = stored(several, "suffix-several")  # apart from the join, whose hot anchors can then be split
    back = F.least(F.col("pos"), F.lit(length - gram_of(length)))
    hits = stored(
        found.select("did", "rid", "pos", "ahead", "anchor", "context").join(several, "anchor"), "suffix-hits"
    ).withColumn("back", back)
    owners = found.select("rid", *KEY).distinct().join(hits.select("rid").distinct(), "rid", "left_semi")
    owners = stored(owners, "suffix-owners")

    # contexts of each anchor, each with its first place
    unlike = stored(
        hits.groupBy("anchor", "context").agg(
            F.count("*").alias("times"),
            F.min(F.struct("did", "rid", "pos")).alias("first"),
            F.max("back").alias("back"),
            F.max("ahead").alias("ahead"),
        ),
        "suffix-contexts",
    )
    kinds = stored(
        unlike.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-kinds"
    )
    buckets = int(kinds.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]) // BUCKET + 1
    several_kinds = (
        unlike.join(kinds, "anchor")
        .select("anchor", "context", "kinds", "back", "ahead", "first.did", "first.rid", "first.pos")
        .join(small(owners).select("rid", "key"), "rid")
    )
    texts = keyed.select(*KEY, "raw").join(small(owners).select(*KEY).distinct(), KEY, "left_semi")
    cut = F.col("raw").substr(F.col("pos") - F.col("back") + 1, F.col("back") + F.col("ahead"))
    contexts = several_kinds.join(texts, KEY).select("anchor", "context", "kinds", "back", "did", "rid", "pos", cut.alias("raw"))
    # rows alike in id and text give a context twice, which stays one
    cool = (
        contexts.filter(F.col("kinds") <= group)
        .withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_bucket_reach(length), REACH)
    )
    hot = contexts.filter(F.col("kinds") > group).dropDuplicates(["anchor", "context"])
    reach = stored(cool.unionByName(_hot_reach(hot, length)), "suffix-reach")

    facts = unlike.select("anchor", "context", "times", F.col("first.rid").alias("first_rid"), F.col("first.pos").alias("first_pos"))
    facts = facts.join(reach, ["anchor", "context"], "left")
    placed = hits.join(facts, ["anchor", "context"])
    is_first = (F.col("rid") == F.col("first_rid")) & (F.col("pos") == F.col("first_pos"))
    whole = (F.col("times") > 1) & (~is_first if keep_first else F.lit(True))
    lo, hi = ("later_lo", "later_hi") if keep_first else ("lo", "hi")
    runs = (
        placed.select(
            "rid",
            F.when(whole, F.col("pos") - F.col("back")).when(F.col(lo) <= F.col(hi), F.col("pos") + F.col(lo)).alias("begin"),
            F.when(whole, F.col("pos") + F.col("ahead")).when(F.col(lo) <= F.col(hi), F.col("pos") + F.col(hi) + length).alias("end"),
        )
        .filter("begin is not null")
        .groupBy("rid")
        .agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    )
    # rows with one id and text: what goes from one of them goes from all but with keep_first from the later ones
    of_text = owners.join(runs, "rid", "left").groupBy(*KEY).agg(
        (F.min_by("runs", "rid") if keep_first else F.max_by("runs", F.size(F.coalesce("runs", F.array())))).alias("runs")
    )
    of_text = stored(of_text.filter("runs is not null"), "suffix-runs")
    losing = small(of_text.select(*KEY))
    return keyed.select(*KEY, "raw").join(losing, KEY, "left_semi"), of_text


def merged(runs: list) -> list[tuple[int, int]]:
    """Runs of bytes joined where they touch or overlap, in order."""
    out: list[list[int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in runs):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in rows_of(batches, 500):
        out = []
        for did, key, raw, runs in zip(rows["did"], rows["key"], rows["raw"], rows["runs"], strict=True):
            spans = merged(list(runs))
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((did, key, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
        yield pd.DataFrame(out, columns=["did", "key", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


CUT = (
    "did long, key long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
    "spans array<struct<begin: int, end: int>>"
)


def _cuts(docs: DataFrame, length: int, keep_first: bool, id_column: str, text_column: str, group: int) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(docs, id_column, text_column)
    texts, runs = _repeated(keyed, length, keep_first, group)
    cut = texts.join(runs, KEY).mapInPandas(_cut, CUT)
    return keyed, cut


def report(
    docs: DataFrame, length: int = 200, keep_first: bool = False, id_column: str = "doc_id", text_column: str = "text", group: int = GROUP
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed, cut = _cuts(docs, length, keep_first, id_column, text_column, group)
    cut = cut.drop("kept", "spans").dropDuplicates(KEY)
    light = keyed.select("doc_id", *KEY, F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("own"))
    none = F.lit(0).cast("long")
    return light.join(cut, KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"),
    )


def removed_spans(
    docs: DataFrame, length: int = 200, keep_first: bool = True, id_column: str = "doc_id", text_column: str = "text", group: int = GROUP
) -> DataFrame:
    """The runs of bytes that go: doc_id, begin, end; documents that lose nothing have no row."""
    keyed, cut = _cuts(docs, length, keep_first, id_column, text_column, group)
    spans = cut.select(*KEY, F.explode("spans").alias("s")).select(*KEY, "s.begin", "s.end").distinct()
    return keyed.select("doc_id", *KEY).join(spans, KEY).select("doc_id", "begin", "end")


def deduplicated(
    docs: DataFrame, length: int = 200, keep_first: bool = True, id_column: str = "doc_id", text_column: str = "text", group: int = GROUP
) -> DataFrame:
    """doc_id and kept, the bytes of each document that stay; cuts may fall within a character."""
    keyed, cut = _cuts(docs, length, keep_first, id_column, text_column, group)
    kept = cut.select(*KEY, "kept").dropDuplicates(KEY)
    return keyed.join(kept, KEY, "left").select("doc_id", F.coalesce("kept", "raw").alias("kept"))
