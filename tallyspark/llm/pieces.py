"""Encoding and decoding with a piece vocabulary, with the N best segmentations.

A text is a lattice of pieces; a segmentation is a path, its score the sum of its
pieces' scores. A forward Viterbi pass gives the best score up to every position.
These are exact heuristics for an A-star search from the end backwards: the sum
of such a score and the score of the path so far is what the best completion
reaches, so paths come out of the queue in the order of their scores, and the
first N are the N best.

A space is written as the mark U+2581, and one is put before a text. No piece of
the vocabulary has a mark after another character (`Vocabulary` checks that), so
the lattice falls apart before every run of marks, and its units are searched one
by one. The N best of a text come from the N - 1 units whose second best path
loses least: any other change could be exchanged for N - 1 better ones. The
forward pass keeps the two best scores of a position, so it tells what a second
path loses; the search itself runs for those N - 1 units only. Units that recur
are kept in a bounded cache. Memory is bounded by the longest text, some thirty bytes for each
character of its longest unit; frames are bounded by the length of their texts.

A character without a piece of its own is an edge with the lowest score of all
pieces less 10, and becomes the pieces of its bytes. So does a mark that is in
the text itself, and decoding gives every text back, byte for byte. Null and
empty texts have no pieces and one segmentation of score 0. Of paths with
equal scores the best is the one with the longest last piece, and so on backwards;
the others follow as `n_best` says. Rows stay rows, whatever repeats. An empty table
gives an empty result. Of further columns, those asked for go through, whatever their
names, but for those named like a result.
The vocabulary is given by path and never trained; its size bounds the broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import rows_of, text_or_empty, unused

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_UNITS = 64_000  # of each of two generations; a unit of 64 characters takes 350 to 600 bytes
CACHED_PATHS = 10_000
LONGEST_CACHED = 64
LONGEST_LISTED = 4096
FRAME_ROWS = 500
FRAME_SIZE = 4_000_000  # characters or pieces of a frame; a longer row is a frame of its own
LEAF = ({}, 0.0, None)
UNKNOWN = -1
NEVER = -1e300
BLOCKED = -1e8  # models give such scores to runs of marks, which no merge makes; here they get the lowest other score


def read_model(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the number of the piece of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        pieces.append(("" if special else model.id_to_piece(i), model.get_score(i)))
    lowest = min(score for piece, score in pieces if piece and score > BLOCKED)
    pieces = [(piece, max(score, lowest)) for piece, score in pieces]
    bytes_at = next(i for i in range(model.get_piece_size()) if model.is_byte(i))
    return pieces, bytes_at


class Vocabulary:
    """Pieces by text, by number, and as a tree of characters, which tells a search when to stop."""

    def __init__(self, pieces: Sequence[tuple[str, float]], bytes_at: int):
        self.bytes_at = bytes_at
        self.texts = [p.replace(MARK, " ").encode() for p, _ in pieces]  # special ones are empty
        for i in range(256):
            self.texts[bytes_at + i] = bytes([i])
        self.spellings = np.array(self.texts, dtype=object)
        self.pieces = {piece: (score, i) for i, (piece, score) in enumerate(pieces) if piece}
        self.longest = max(map(len, self.pieces))
        self.unknown = min(score for score, _ in self.pieces.values()) - 10
        # a node: children, score and number of the piece that ends there, if one does; leaves share one dict
        self.root: dict[str, tuple] = {}
        for piece, (score, i) in self.pieces.items():
            if re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError("a piece has a mark after another character")
            children = self.root
            for character in piece[:-1]:
                node = children.get(character, LEAF)
                if node[0] is LEAF[0]:
                    node = children[character] = ({}, *node[1:])
                children = node[0]
            children[piece[-1]] = (children.get(piece[-1], LEAF)[0], score, i)

    def spelt(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes_at + b for b in character.encode("utf-8", "surrogatepass"))

    def decode(self, ids: Sequence[int]) -> str:
        numbers = np.frombuffer(ids, np.int32) if isinstance(ids, array) else np.asarray(ids, np.int32)
        raw = b"".join(self.spellings[numbers].tolist())
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")

    def forward(self, unit: str) -> tuple[Sequence[float], Sequence[float], Sequence[int], Sequence[int]]:
        """The two best scores up to each position, and piece and begin of the last edge of the best path."""
        n = len(unit)
        root, unknown = self.root, self.unknown
        reach, second, last, since = [0.0] + [NEVER] * n, [NEVER] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        if n > LONGEST_LISTED:
            reach, second, last, since = array("d", reach), array("d", second), array("i", last), array("i", since)
        nothing = (LEAF[0], unknown, UNKNOWN)
        for begin in range(n):
            here = reach[begin]
            end = begin + 1
            children, score, piece = root.get(unit[begin], nothing)
            if piece is None:
                # the character begins pieces but is none: an edge of its own, with the lowest score
                score, piece = unknown, UNKNOWN
            while True:
                if piece is not None:
                    through = here + score
                    so_far = reach[end]
                    if through > so_far:
                        other = second[begin] + score
                        second[end] = so_far if so_far > other else other
                        reach[end] = through
                        last[end] = piece
                        since[end] = begin
                    elif through > second[end]:
                        second[end] = through
                if end == n or not children:
                    break
                node = children.get(unit[end])
                if node is None:
                    break
                end += 1
                children, score, piece = node
        return reach, second, last, since

    def traced(self, unit: str, last: Sequence[int], since: Sequence[int]) -> array:
        """Piece numbers of the best path, characters without a piece spelt in bytes."""
        ids: list[int] = []
        end = len(unit)
        while end:
            piece, end = last[end], since[end]
            if piece == UNKNOWN:
                ids += self.spelt(unit[end])[::-1]
            else:
                ids.append(piece)
        return array("i", ids[::-1])

    def best(self, unit: str) -> tuple[float, float, tuple[int, ...]]:
        """Score and pieces of the best path, and by how much the second best is lower (infinite without one)."""
        top, lost, ids = self.best_path(unit)
        return top, lost, tuple(ids)

    def best_path(self, unit: str) -> tuple[float, float, array]:
        reach, second, last, since = self.forward(unit)
        top, other = reach[-1], second[-1]
        return top, (top - other if other > NEVER / 2 else np.inf), self.traced(unit, last, since)

    def edges_into(self, unit: str, end: int) -> Iterator[tuple[int, float, int]]:
        """The edges of the lattice that end at a position: begin, score, piece."""
        for begin in range(max(0, end - self.longest), end):
            edge = self.pieces.get(unit[begin:end])
            if edge:
                yield begin, *edge
            elif begin == end - 1:
                yield begin, self.unknown, UNKNOWN

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a unit: A-star from its end, guided by the forward scores.

        Entries of the queue are ends of paths. No path has two of them, and each
        promises a path of just its score, so with k paths still to be found the k
        best entries suffice: the queue stays as short as n. An entry points to the
        one that it prolongs. Of equal scores, the entry nearest to the begin goes
        first, then the smaller piece, then the older.
        """
        reach, _, last, since = self.forward(unit)
        queue: list[tuple] = [(-reach[-1], len(unit), UNKNOWN, 0, 0.0, None)]
        found, made = [], 0
        while queue and len(found) < n:
            _, end, _, _, behind, path = heapq.heappop(queue)
            if end == 0:
                found.append((behind, self.written(unit, path)))
                continue
            for begin, score, piece in self.edges_into(unit, end):
                made += 1
                total = score + behind
                heapq.heappush(queue, (-(reach[begin] + total), begin, piece, made, total, (piece, begin, path)))
            queue = heapq.nsmallest(n - len(found), queue)  # sorted, so still a heap
        # of equally good best paths the one that encoding takes is the first
        ids = tuple(self.traced(unit, last, since))
        return [(reach[-1], ids), *[f for f in found if f[1] != ids]][:n]

    def written(self, unit: str, path: tuple | None) -> tuple[int, ...]:
        """Piece numbers of a path of (piece, begin, rest)."""
        ids: list[int] = []
        while path:
            piece, begin, path = path
            ids += self.spelt(unit[begin]) if piece == UNKNOWN else (piece,)
        return tuple(ids)


def units_of(text: str) -> list[str]:
    """The units of a text; a mark in the text itself is given as an empty unit."""
    if not text:
        return []
    if MARK not in text:
        return UNITS.findall(MARK + text.replace(" ", MARK))
    units: list[str] = []
    for i, part in enumerate(text.split(MARK)):
        if i:
            units.append("")
        units += UNITS.findall((MARK if i == 0 else "") + part.replace(" ", MARK))
    return units


class Encoder(dict):
    """Unit → (score, loss of the second path, piece numbers as bytes).

    Kept in two generations: when the younger is full the elder is forgotten, and
    units that are met again come back from the elder, so frequent ones stay.
    """

    def __init__(self, vocabulary: Vocabulary, cached_units: int = CACHED_UNITS):
        super().__init__()
        self.vocabulary = vocabulary
        self.most = cached_units
        self.elder: dict[str, tuple[float, float, bytes]] = {}
        self.searched: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def __missing__(self, unit: str) -> tuple[float, float, bytes]:
        entry = self.elder.get(unit)
        if entry is None:
            if unit == "":
                entry = (self.vocabulary.unknown, np.inf, array("i", self.vocabulary.spelt(MARK)).tobytes())
            else:
                top, lost, ids = self.vocabulary.best_path(unit)
                entry = (top, lost, ids.tobytes())
        if len(unit) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.elder = dict(self)
                self.clear()
            self[unit] = entry
        return entry

    def encode(self, text: str, n: int = 1) -> tuple[array, list[float]]:
        """Piece numbers of the best segmentation, and the scores of the n best."""
        found = self.ranked(text, n)
        return found[0][1], [score for score, _ in found]

    def paths(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths of a unit, searched once while they are kept."""
        found = self.searched.get((unit, n))
        if found is None:
            found = [(score, array("i", ids).tobytes()) for score, ids in self.vocabulary.n_best(unit, n)]
            if len(unit) <= LONGEST_CACHED:
                if len(self.searched) >= CACHED_PATHS:
                    self.searched.clear()
                self.searched[unit, n] = found
        return found

    def changes(self, units: list[str], losses: Sequence[float], n: int) -> list[tuple[float, tuple]]:
        """The n least losses of a text, each with the (place, rank, pieces) of the units that do not take their best path."""
        rest, first = list(losses), []
        for _ in range(min(n - 1, len(rest))):
            least = min(rest)
            if least == np.inf:
                break
            first.append(rest.index(least))
            rest[first[-1]] = np.inf
        found: list[tuple[float, tuple]] = [(0.0, ())]
        for place in sorted(first):
            paths = self.paths(units[place], n)
            ranked = [
                (paths[0][0] - score, ((place, rank, ids),) if rank else ()) for rank, (score, ids) in enumerate(paths)
            ]
            found = heapq.nsmallest(n, [(a + b, p + q) for a, p in found for b, q in ranked])
        return found

    def ranked(self, text: str, n: int) -> list[tuple[float, array]]:
        """Scores and piece numbers of the n best segmentations of a text."""
        units = units_of(text)
        if not units:
            return [(0.0, array("i"))]
        scores, losses, parts = zip(*map(self.__getitem__, units), strict=True)
        top, own = sum(scores), list(parts)
        found = []
        for lost, changed in self.changes(units, losses, n) if n > 1 else [(0.0, ())]:
            for place, _, ids in changed:
                own[place] = ids
            numbers = array("i")
            numbers.frombytes(b"".join(own))
            for place, _, _ in changed:
                own[place] = parts[place]
            found.append((top - lost, numbers))
        return found

    def segmentations(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text with their scores."""
        return [(score, ids.tolist()) for score, ids in self.ranked(text, n)]


def encoded(
    docs: DataFrame, model_path: str, columns: Sequence[str] = ("doc_id",), text_column: str = "text", n: int = 3,
    cached_units: int = CACHED_UNITS,
) -> DataFrame:
    """The given columns with `pieces` (numbers of the best segmentation), `scores` of the n best, `n_pieces`, and
    `others`, the numbers of the second to n-th. Given columns of these names are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    results = "pieces array<int>, scores array<double>, n_pieces int, others array<array<int>>"
    kept, schema, work = _kept(docs, columns, text_or_empty(text_column), results)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(*sent.value), cached_units)
        for rows in _frames(batches, work):
            found = [encoder.ranked(t, n) for t in rows[work]]
            yield rows.drop(columns=work).assign(
                pieces=[np.frombuffer(f[0][1], dtype=np.int32) for f in found],
                scores=[[score for score, _ in f] for f in found],
                n_pieces=[len(f[0][1]) for f in found],
                others=[[np.frombuffer(ids, dtype=np.int32) for _, ids in f[1:]] for f in found],
            )

    return kept.mapInPandas(encode, schema)


def encoding_report(
    docs: DataFrame, model_path: str, columns: Sequence[str] = ("doc_id",), text_column: str = "text", n: int = 3,
    cached_units: int = CACHED_UNITS,
) -> DataFrame:
    """As `encoded`, with the SHA-256 of the piece numbers (four bytes each, low byte first) in their place, and
    whether they decode to the very text; `all_sha256` and `all_round_trip` say so for each of the n best."""
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    results = (
        "n_pieces long, scores array<double>, pieces_sha256 string, round_trip boolean, "
        "all_sha256 array<string>, all_round_trip array<boolean>"
    )
    kept, schema, work = _kept(docs, columns, text_or_empty(text_column), results)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(*sent.value), cached_units)
        for rows in _frames(batches, work):
            found = []
            for text in rows[work]:
                ranked = encoder.ranked(text, n)
                digests = [hashlib.sha256(np.frombuffer(ids, dtype="<i4")).hexdigest() for _, ids in ranked]
                back = [encoder.vocabulary.decode(ids) == text for _, ids in ranked]
                found.append((len(ranked[0][1]), [score for score, _ in ranked], digests[0], back[0], digests, back))
            names = ("n_pieces", "scores", "pieces_sha256", "round_trip", "all_sha256", "all_round_trip")
            yield rows.drop(columns=work).assign(**{c: [f[i] for f in found] for i, c in enumerate(names)})

    return kept.mapInPandas(report, schema)


def decoded(encodings: DataFrame, model_path: str, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns with the `text` of `pieces`; null pieces give an empty text."""
    sent = encodings.sparkSession.sparkContext.broadcast(read_model(model_path))
    kept, schema, work = _kept(
        encodings, columns, F.coalesce("pieces", F.array().cast("array<int>")), "text string"
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(*sent.value)
        for rows in _frames(batches, work):
            yield rows.drop(columns=work).assign(text=[vocabulary.decode(ids) for ids in rows[work]])

    return kept.mapInPandas(decode, schema)


def _kept(docs: DataFrame, columns: Sequence[str], worked_on: Column, results: str) -> tuple[DataFrame, str, str]:
    """The given columns but those named like a result, with the one that is worked on; the schema of both; its name."""
    made = {part.split()[0] for part in results.split(", ")}
    through = docs.select(*[F.col(f"`{c}`") for c in columns if c.lower() not in made])
    work = unused(through.columns, "_work")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in through.schema) + results
    return docs.select(*[F.col(f"`{c}`") for c in through.columns], worked_on.alias(work)), schema, work


def _frames(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The same rows in frames of bounded size."""
    for rows in rows_of(batches, FRAME_ROWS):
        begin = size = 0
        for i, length in enumerate(map(len, rows[column])):
            size += length
            if i > begin and size > FRAME_SIZE:
                yield rows.iloc[begin:i]
                begin, size = i, length
        yield rows.iloc[begin:]
