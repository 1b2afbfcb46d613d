"""Token alignment against a plain version that encodes whole texts and compares all neighbouring tokens by bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from tallyspark.llm import token_alignment
from tallyspark.llm.shared import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
EDGES = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b  c ", "x▁y z", "a ▁b", "<|endoftext|> and <s> </s> <0x41>",
    "tabs\tand\nlines \n b", " x   y", "de l'eau, it's we'll 12345 6.7e8", "日本語のテキスト 漢字", "é ́ x", "a\x00b c",
    "\x1c a \x85 b", "🙂 🙂🙂 ok", "word " * 300, "Zq" * 3000, "same same same same",
]


def spans(tokens: list[bytes]) -> list[tuple[int, int]]:
    at, found = 0, []
    for t in tokens:
        found.append((at, at + len(t)))
        at += len(t)
    return found


def plain(texts: list[str | None]) -> list[dict]:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = token_alignment.byte_letters()
    rows, held = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode() if text else b""
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            ids_a, ids_b, raw_a, raw_b = [], [], [], []
        spans_a, spans_b = spans(raw_a), spans(raw_b)
        shared = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, starts = [], [0, 0]
        for end in shared:
            cut = []
            for side, (ids, where) in enumerate(((ids_a, spans_a), (ids_b, spans_b))):
                stop = starts[side]
                while stop < len(where) and where[stop][1] <= end:
                    stop += 1
                cut.append(",".join(map(str, ids[starts[side] : stop])))
                starts[side] = stop
            groups.append("|".join(cut))
        links = [(i, j) for i, (s, e) in zip(ids_a, spans_a) for j, (t, f) in zip(ids_b, spans_b) if s < f and t < e] if len(ids_a) < 300 else None
        if links is None:  # the same by bytes, for long texts
            at_a = [k for k, (s, e) in enumerate(spans_a) for _ in range(e - s)]
            at_b = [k for k, (s, e) in enumerate(spans_b) for _ in range(e - s)]
            links = [(ids_a[k], ids_b[m]) for k, m in dict.fromkeys(zip(at_a, at_b))]
        held.update(set(links))
        text_of = ";".join(groups)
        rows.append(
            {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": len(groups), "n_links": len(links), "links": links,
             "groups_sha256": hashlib.sha256(text_of.encode()).hexdigest() if ids_a else ""}
        )
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    for row in rows:
        links = row.pop("links")
        row["n_best"] = sum(held[x] == best[x[0]] for x in links)
        row["count_sum"] = sum(held[x] for x in links)
    return rows


def compared(frame) -> list[tuple]:
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    return sorted([tuple(r[n] for n in names) for r in frame])


def test_given_documents(spark):
    docs = table(spark, SMALL, "documents")
    texts = [r["text"] for r in docs.collect()]
    assert compared([r.asDict() for r in token_alignment.report(docs, A, B).collect()]) == compared(plain(texts))


def test_edges_small_batches_and_no_memory(spark, monkeypatch):
    draw = random.Random(5)
    marks = ["a", "b ", " ", "  ", "▁", "é", "\n", "'s", "10", "-", "漢", "\t", "The", " "]
    texts = EDGES + EDGES[:6] + ["".join(draw.choices(marks, k=draw.randint(1, 30))) for _ in range(200)]
    rows = [(i if i % 7 else None, t, "x", "y", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, batch string, n_docs int").repartition(3)
    want = compared(plain(texts))
    found = token_alignment.report(docs, A, B).collect()
    assert compared([r.asDict() for r in found]) == want
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    tool = token_alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    whole = [c.to_pylist() for c in tool.columns(texts)]
    tool.stretches.most = 10
    monkeypatch.setattr(token_alignment, "MOST_WINDOWS", 5)
    single = [[c.to_pylist()[0] for c in tool.columns([t])] for t in texts]
    assert single == list(map(list, zip(*whole)))
    tool.splits = False
    assert [c.to_pylist() for c in tool.columns(texts)] == whole


def test_bytes_that_are_no_text_and_empty_tables(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'ok'")
    found = {r["doc_id"]: r for r in token_alignment.report(docs, A, B).collect()}
    assert (found[1]["n_a"], found[1]["n_links"], found[1]["groups_sha256"]) == (0, 0, "") and found[2]["n_a"] > 0
    assert token_alignment.report(docs.filter("doc_id > 5"), A, B).collect() == []


def test_batches_share_counts(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    base = token_alignment.report(docs, A, B)
    aligned = token_alignment.alignments(docs.coalesce(1), A, B)
    assert base.count() == aligned.count()
    monkeypatch.setattr(token_alignment, "BATCH_BYTES", 2000)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 500)
    small = token_alignment.report(docs.coalesce(2), A, B)
    assert compared([r.asDict() for r in small.collect()]) == compared([r.asDict() for r in base.collect()])


@pytest.mark.parametrize("letters", [256])
def test_byte_letters_are_one_to_one(letters):
    found = token_alignment.byte_letters()
    assert len(found) == letters and sorted(found.values()) == list(range(256))
