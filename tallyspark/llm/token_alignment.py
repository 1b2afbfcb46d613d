"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE (a `tokenizers` file), B a piece model with byte fallback
(a `sentencepiece` file). Both encode a space and the text, without special tokens. A
text whose tokens do not spell these bytes on both sides has no tokens at all.

After full tokenisation the ends of all tokens are byte offsets. Ends that A and B share
are verified by marking both in one array; they cut a text into groups. A shared end
before two tokens that both begin with a space is an anchor, and anchors split a text into
windows, which are tuples of token ids. Equal windows align alike, so the groups and links
of a window are worked out once and kept under its id tuples; a text's result is put
together from those of its windows. A link is a pair of an A and a B token occurrence
with overlapping bytes.

How many documents hold a linked id pair is counted over all of them. Texts are dealt to
batches of `BATCH_BYTES`; the different pairs of a batch are counted first, so a pair is
shuffled once a batch however often it occurs, and each batch gets back the counts of its
own pairs only. Nothing that grows with the corpus is broadcast or collected.

Tokenising meets the same words again and again. No token crosses a single space between
two characters that are neither white space nor U+2581 (`Aligner` checks the vocabularies
for it and takes whole texts otherwise), so a text is tokenised in the stretches between,
each of which is encoded, verified and split into windows once and kept. Both memories
are bounded, and what they forget is worked out again.

Null and empty texts, texts with U+2581 and texts that are not valid UTF-8 have no tokens:
zeros and empty lists. A text of any length without white space is one window. Rows stay
rows, whatever repeats, null ids too; repeated rows count as documents of their own. An empty
table gives an empty one. Other columns than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyspark.llm.shared import stored

MARK = "▁"
STRETCHES = re.compile(rf"(?<=[^\s{MARK}])(?= [^\s{MARK}])")
BATCH_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2000
LEARN_ROWS = 8192
MOST_STRETCHES = 400_000
MOST_WINDOWS = 20_000
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level vocabularies cut texts


def byte_letters() -> dict[str, int]:
    """The letters a byte-level vocabulary writes for the bytes 0 to 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in plain)
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


def taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of a flat array one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Stretches:
    """Results of stretches under their texts, in flat arrays. When these are full, the half that was asked for least goes."""

    def __init__(self, most: int):
        self.most = most  # stretches, or 64 times as many bytes
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, 6), dtype=np.int64)  # A tokens, B tokens, groups, wrongly spelt, links, bytes of groups as text
        self.codes, self.text, self.used = np.zeros(0, "<i8"), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.place()

    def add(self, parts: list[str], counts: np.ndarray, codes: bytes, text: bytes) -> None:
        self.number.update(zip(parts, range(len(self.counts), len(self.counts) + len(parts))))
        self.counts = np.concatenate([self.counts, counts])
        self.codes = np.concatenate([self.codes, np.frombuffer(codes, "<i8")])
        self.text = np.concatenate([self.text, np.frombuffer(text, np.uint8)])
        self.used = np.concatenate([self.used, np.zeros(len(parts), np.int64)])
        self.place()

    def place(self) -> None:
        self.codes_at = np.cumsum(self.counts[:, 4]) - self.counts[:, 4]
        self.text_at = np.cumsum(self.counts[:, 5]) - self.counts[:, 5]

    def shrink(self) -> None:
        """To be called between chunks, since stretches of the chunk at work must stay."""
        if len(self.counts) <= self.most and len(self.text) + 8 * len(self.codes) <= 64 * self.most:
            return
        sizes = np.cumsum(self.counts[order := np.argsort(-self.used, kind="stable"), 5])
        stay = order[: min(self.most // 2, int(np.searchsorted(sizes, 16 * self.most)))]
        new = np.full(len(self.counts), -1)
        new[stay] = np.arange(len(stay))
        self.number = {part: j for part, j in zip(self.number, new[list(self.number.values())].tolist()) if j >= 0}
        self.codes = taken(self.codes, self.codes_at[stay], self.counts[stay, 4])
        self.text = taken(self.text, self.text_at[stay], self.counts[stay, 5])
        self.counts, self.used = self.counts[stay], self.used[stay] // 2
        self.place()


class Aligner:
    def __init__(self, file_a: str, file_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(file_a)
        whole.encode_special_tokens = True
        self.a = lambda texts: [row.ids for row in whole.encode_batch_fast(texts, add_special_tokens=False)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        letters = byte_letters()
        spelt_a = [b""] * whole.get_vocab_size(with_added_tokens=True)
        for token, i in whole.get_vocab(with_added_tokens=True).items():
            plain = all(x in letters for x in token)
            spelt_a[i] = bytes(letters[x] for x in token) if plain else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelt_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.spelt = spelt_a, spelt_b
        self.lengths = tuple(np.array([len(t) for t in side], dtype=np.int64) for side in self.spelt)
        self.spaced = tuple(np.array([t[:1] == b" " for t in side]) for side in self.spelt)
        self.base = len(spelt_b)
        self.words = [f"{i}{stop}" for i in range(max(map(len, self.spelt))) for stop in ",|;"]
        rules = json.loads(file_a)
        splitter = rules.get("pre_tokenizer") or {}
        byte_level = (
            splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and not rules.get("normalizer")
        )
        self.splits = byte_level and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        if byte_level:
            self.read_ranks(rules["model"], letters)
        self.stretches = Stretches(MOST_STRETCHES)
        self.windows: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}

    def read_ranks(self, model: dict, letters: dict[str, int]) -> None:
        """Encode A by `tiktoken`, several times faster, if merges come in the order of their ids, as that library merges."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        order = [model["vocab"].get("".join(m), -1) for m in merges]
        ranks = {bytes(letters[x] for x in token): i for token, i in model["vocab"].items() if all(x in letters for x in token)}
        made = {bytes(letters[x] for m in merge for x in m) for merge in merges}
        plain = {t: i for t, i in ranks.items() if len(t) == 1 or t in made}
        simple = not (model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"))
        if simple and len(plain) == 256 + len(made) == 256 + len(merges) and all(i < j for i, j in zip([255, *order], order)):
            encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=plain, special_tokens={})
            self.a = lambda texts: [encoding.encode_ordinary(text) for text in texts]

    @property
    def code_type(self):
        """Of a pair's code: the A id times the number of B ids, plus the B id."""
        return IntegerType() if len(self.spelt[0]) * self.base < 1 << 31 else LongType()

    def tokens(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A ids and B ids of all stretches in a row, and how many ids of them each stretch has: none if they do not spell it."""
        # a stretch begins with the space that B puts before its input
        rows = self.a(parts), self.b.encode([p[1:] for p in parts], num_threads=1)
        wanted = [p.encode() for p in parts]
        ids, sizes, same = [], [], np.ones(len(parts), dtype=bool)
        for side, spelt, lengths in zip(rows, self.spelt, self.lengths):
            flat = list(chain.from_iterable(side))
            ids.append(np.array(flat, dtype="<i4"))
            sizes.append(np.array([len(r) for r in side], dtype=np.int64))
            until = np.concatenate([[0], np.cumsum(lengths[ids[-1]])])[np.cumsum(sizes[-1])].tolist()
            text = b"".join(map(spelt.__getitem__, flat))
            same &= [text[i:j] == want for i, j, want in zip([0, *until], until, wanted)]
        return [i[np.repeat(same, n)] for i, n in zip(ids, sizes)], [np.where(same, n, 0) for n in sizes]

    def ends(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens of either side end, in order, and whether one of A and one of B does."""
        marks = np.zeros(int(self.lengths[0][ids_a].sum()) + 1, dtype=np.uint8)
        marks[np.cumsum(self.lengths[0][ids_a])] = 1
        marks[np.cumsum(self.lengths[1][ids_b])] |= 2
        at = np.flatnonzero(marks)
        kinds = marks[at]
        return at, kinds & 1 > 0, kinds & 2 > 0

    def align(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Work out windows: the groups of each as text, and the codes of its links.

        Between two neighbouring ends lies a part of one A and one B token, and two tokens that
        overlap have just one such part in common. So parts are links.
        """
        flat_a, flat_b = b"".join([k[0] for k in keys]), b"".join([k[1] for k in keys])
        ids_a, ids_b = np.frombuffer(flat_a, "<i4"), np.frombuffer(flat_b, "<i4")
        _, end_a, end_b = self.ends(ids_a, ids_b)
        a, b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        codes = (ids_a[a].astype("<i8") * self.base + ids_b[b]).tobytes()
        shared = end_a & end_b
        until_a, until_b = np.cumsum(end_a)[shared], np.cumsum(end_b)[shared]
        # a token's place in the text is after the tokens before it on its side and those of the other side in earlier groups (B) or also its own (A)
        group_a, group_b = (np.searchsorted(until, np.arange(len(ids)), "right") for until, ids in ((until_a, ids_a), (until_b, ids_b)))
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], until_b])[group_a]
        place_b = np.arange(len(ids_b)) + until_a[group_b]
        texts = np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        texts[place_a], texts[place_b] = ids_a, ids_b
        texts *= 3
        texts[place_a[until_a - 1]] += 1
        texts[place_b[until_b - 1]] += 2
        words = list(map(self.words.__getitem__, texts.tolist()))
        sizes_a, sizes_b = (np.cumsum(np.array([len(k[side]) // 4 for k in keys])) for side in (0, 1))
        links = np.searchsorted(np.cumsum(end_a & end_b), np.searchsorted(until_a, sizes_a) + 1) + 1
        i = c = 0
        for key, i2, c2 in zip(keys, (sizes_a + sizes_b).tolist(), (8 * links).tolist()):
            self.windows[key] = "".join(words[i:i2]).encode(), codes[c:c2]
            i, c = i2, c2

    def learn(self, parts: list[str]) -> None:
        """Tokenise stretches, split them into windows, and keep the result of each."""
        (ids_a, ids_b), (n_a, n_b) = self.tokens(parts)
        flat_a, flat_b = ids_a.tobytes(), ids_b.tobytes()
        _, end_a, end_b = self.ends(ids_a, ids_b)
        shared = end_a & end_b
        next_a, next_b = np.cumsum(end_a)[shared], np.cumsum(end_b)[shared]
        anchor = np.ones(len(next_a), dtype=bool)  # the last shared end is the end of a stretch
        anchor[:-1] = self.spaced[0][ids_a[next_a[:-1]]] & self.spaced[1][ids_b[next_b[:-1]]]
        cuts_a, cuts_b = next_a[anchor], next_b[anchor]
        bounds_a, bounds_b = ([0, *(4 * c).tolist()] for c in (cuts_a, cuts_b))
        keys = [(flat_a[i:j], flat_b[k:m]) for i, j, k, m in zip(bounds_a, bounds_a[1:], bounds_b, bounds_b[1:])]
        if len(self.windows) > MOST_WINDOWS or sum(map(len, parts)) > CHUNK_BYTES:
            self.windows.clear()
        missing = list(set(keys).difference(self.windows))
        if missing:
            self.align(missing)
        found = list(map(self.windows.__getitem__, keys))
        until = np.searchsorted(cuts_a, np.cumsum(n_a), "right")  # windows up to the end of each stretch
        groups = np.diff(np.searchsorted(next_a, np.cumsum(n_a), "right"), prepend=0)
        links, sizes = (np.concatenate([[0], np.cumsum([len(x[side]) for x in found])]).astype(np.int64) for side in (1, 0))
        counts = np.stack([n_a, n_b, groups, n_a == 0, np.diff(links[until], prepend=0) // 8, np.diff(sizes[until], prepend=0)], axis=1).astype(np.int64)
        self.stretches.add(parts, counts, b"".join([x[1] for x in found]), b"".join([x[0] for x in found]))

    def columns(self, texts: list[str | None]) -> list[pa.Array]:
        """Per text: tokens of A, of B, groups, links, groups as text, codes of linked pairs and how often each is linked."""
        split = STRETCHES.split if self.splits else lambda text: [text]
        known = self.stretches
        known.shrink()
        parts = [split(" " + text) if text else [] for text in texts]
        flat = list(chain.from_iterable(parts))
        new = list(set(flat).difference(known.number))
        for i in range(0, len(new), LEARN_ROWS):
            self.learn(new[i : i + LEARN_ROWS])
        stretch = np.fromiter(map(known.number.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), np.array([len(p) for p in parts], dtype=np.int64))
        del parts, flat
        known.used += np.bincount(stretch, minlength=len(known.used))
        wrong = np.zeros(len(texts), dtype=bool)
        wrong[row[known.counts[stretch, 3] > 0]] = True
        right = ~wrong[row]
        stretch, row = stretch[right], row[right]
        counts = known.counts[stretch]
        sums = [np.diff(np.concatenate([[0], np.cumsum(counts[:, c])])[np.searchsorted(row, np.arange(len(texts)), "right")], prepend=0) for c in (0, 1, 2, 4, 5)]
        text = taken(known.text, known.text_at[stretch], counts[:, 5])
        ends = np.cumsum(sums.pop())
        text = np.delete(text, ends[sums[0] > 0] - 1)  # without the last separator of each
        ends -= np.cumsum(sums[0] > 0)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        keys = np.sort((np.repeat(row, counts[:, 4]) << 40) + taken(known.codes, known.codes_at[stretch], counts[:, 4]))
        first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[: len(keys)])
        lists = np.searchsorted(keys[first], np.arange(len(texts) + 1) << 40).astype(np.int32)
        codes, times = keys[first] & (1 << 40) - 1, np.diff(first, append=len(keys))
        return [
            *(pa.array(x, pa.int64()) for x in sums),
            pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(text)),
            pa.ListArray.from_arrays(lists, pa.array(codes, pa.int32() if self.code_type == IntegerType() else pa.int64())),
            pa.ListArray.from_arrays(lists, pa.array(times, pa.int32())),
        ]


_aligners: dict[tuple[str, str], Aligner] = {}  # of this worker; one pair of tokenizers at a time


def aligner(key: tuple[str, str], files) -> Aligner:
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*files.value)
    return _aligners[key]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None], int]]:
    """Ids, texts and bytes of some rows at a time; bytes that are no UTF-8 count as no text."""
    column = batch.column(1)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        end, filled = start, 0
        while end < len(sizes) and (end == start or (filled + sizes[end] <= CHUNK_BYTES and end - start < CHUNK_ROWS)):
            filled += int(sizes[end])
            end += 1
        texts = []
        for raw in column.slice(start, end - start).to_pylist():
            try:
                texts.append(raw.decode() if raw else None)
            except UnicodeDecodeError:
                texts.append(None)
        yield batch.column(0).slice(start, end - start), texts, filled
        start = end


def alignments(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, `groups` as text, and the linked id pairs with how often each is linked.

    `pairs` holds the codes (A id times the size of B's vocabulary plus B id), ascending, `times` the links of each.
    `batch` numbers the batch of texts the row was dealt to; it is stable only once written.
    """
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        contents = a.read(), b.read()
    code = Aligner(*contents).code_type
    files = spark.sparkContext.broadcast(contents)  # two vocabularies
    key = (path_a, path_b)
    id_field = docs.select(F.col(id_column).alias("doc_id")).schema[0]
    schema = StructType(
        [StructField("batch", LongType()), id_field]
        + [StructField(name, LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")]
        + [StructField("groups", StringType()), StructField("pairs", ArrayType(code)), StructField("times", ArrayType(IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(key, files)
        number, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for ids, texts, size in chunks(batch):
                if filled and filled + size > BATCH_BYTES:
                    number, filled = number + 1, 0
                filled += size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), number)), ids, *tool.columns(texts)], names=schema.names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """(batch, pair) of a written frame of `alignments`, and per pair the documents that hold it and whether no pair of its A id has more."""
    by_batch = stored(aligned.select("batch", F.explode("pairs").alias("pair")).groupBy("batch", "pair").agg(F.count("*").alias("n")), "pairs")
    totals = by_batch.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.floor(F.col("pair") / base).cast("int"))
    most = totals.groupBy("a").agg(F.max("n_docs").alias("most"))
    facts = totals.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    return by_batch, facts


def report(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the sizes of its alignment, `groups_sha256`, and its links against the counts of the corpus.

    `n_best` counts the links whose pair no other pair of the same A id exceeds in documents, `count_sum`
    adds the documents of the pair over all links.
    """
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = alignments(docs, path_a, path_b, id_column, text).withColumn("groups_sha256", digest).drop("groups")
    aligned = stored(rows, "aligned")
    by_batch, facts = pair_counts(aligned, base)
    marked = by_batch.join(facts, "pair").select("batch", "pair", "n_docs", "best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = StructType([aligned.schema[c] for c in kept] + [StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def sums(rows: pa.Table, facts: pa.Table) -> pa.Table:
        order = np.argsort(facts["pair"].to_numpy())
        pair, n, best = (facts[c].to_numpy()[order] for c in ("pair", "n_docs", "best"))
        lists, times = rows["pairs"].combine_chunks(), rows["times"].combine_chunks()
        at = np.searchsorted(pair, pc.list_flatten(lists).to_numpy())
        times = pc.list_flatten(times).to_numpy().astype(np.int64)
        until = np.cumsum(pc.list_value_length(lists).to_numpy())
        out = rows.select(kept)
        for name, each in (("n_best", times * best[at]), ("count_sum", times * n[at])):
            added = np.concatenate([[0], np.cumsum(each)])[until]
            out = out.append_column(name, pa.array(np.diff(added, prepend=0), pa.int64()))
        return out

    return aligned.groupBy("batch").cogroup(marked.groupBy("batch")).applyInArrow(sums, schema)
