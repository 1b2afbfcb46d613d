"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tallyspark.llm import (
    content_archive,
    cross_entropy,
    exact_dedup,
    jaccard_join,
    metric_join,
    pieces,
    queries,
    source_mix,
    suffix_dedup,
    toxicity,
    url_rules,
)

PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "Alpha beta\tgamma"),
    (2, "Alpha beta gamma"),
    (3, "alphabetagamma "),
    (4, None),
    (5, ""),
    (6, " \n\t"),
    (7, "one"),
    (8, PASSAGE + " tail one of the first"),
    (9, PASSAGE + " tail two of the second"),
    (10, "é漢字 😀 " + PASSAGE),
    (11, LONG),
    (12, LONG + " end"),
    (12, LONG + " end"),
    (None, "no id here"),
    (None, "Alpha beta gamma"),
    (13, PASSAGE + " tail one of the first"),
    (14, "a" * 700),
]
CLASH = "size long, kept boolean, content string, component_id long, text_sha256 string, score double, rid long, rule string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def rows(texts):
    sources = [None, "b", "a", "b", "b"]
    return [(i, t, "en", sources[k % 5], len(t or ""), 1, True, "x", 2, "y", 0.5, 3, "z") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counted(frame, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_exact_dedup(docs, none):
    want = collections.Counter()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    for i, t in TEXTS:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[plain])[3]
        want[(i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest())] += 1
    got = exact_dedup.groups_of(docs)
    assert counted(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 10, 11, 12, 14]
    assert exact_dedup.groups_of(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_source_mix(docs, none):
    got = source_mix.mix(docs).collect()
    sizes = collections.Counter()
    for k, (_, t) in enumerate(TEXTS):
        sizes[[None, "b", "a", "b", "b"][k % 5]] += len(words(t))
    total, weights, open_ = sum(sizes.values()), {"a": 5, "b": 2, None: 1}, {"a", "b", None}
    targets = {}
    while True:
        left = total - sum(targets.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 3 * sizes[s]}
        if not over:
            targets |= shares
            break
        targets |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = source_mix.mix(docs.repartition(5))
    assert counted(again, "doc_id", "size", "taken") == collections.Counter((r.doc_id, r.size, r.taken) for r in got)
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns and max(counted(mixed, "doc_id").values()) <= 6
    assert source_mix.mix(none).count() == 0 and source_mix.mixed_documents(none).count() == 0


def test_source_mix_keeps_to_targets_within_a_word(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for weights in ((5, 2, 1), (1, 1, 40)):
        by = collections.defaultdict(list)
        for r in source_mix.mix(table, weights=weights).collect():
            by[r.source, r.target].append(r.taken)
        assert all(abs(sum(v) - target) <= 1 for (_, target), v in by.items())


def test_content_archive(spark):
    schema = "page_id long, url string, html string, digest string, payload string, header string, length long"
    html = "<p>" + "x" * 200 + "</p>"
    table = [
        (5, "http://a/\r\nb", html), (2, "http://a/c", html), (9, None, html), (3, "http://d/", "short"),
        (4, "http://d/", "short"), (6, "", None), (7, "http://e", ""), (8, "http://ü/", "é" * 50), (2, "http://a/c", html),
        (10, "http://z", "WARC/1.1\r\n\r\n" + html), (None, "http://n", html),
    ]
    pages = spark.createDataFrame([(*r, "d", "p", "h", 1) for r in table], schema)
    path = content_archive.write_archive(pages)
    records = content_archive.records(spark, path).withColumn("warc", content_archive.warc_bytes()).collect()
    assert len(records) == len(table)
    for r in records:
        wanted = [(h or "").encode() for i, _, h in table if i == r.page_id]
        assert bytes(r.payload) in wanted and r.payload_digest == hashlib.sha256(r.payload).hexdigest()
        copies = [i for i, _, h in table if (h or "").encode() == bytes(r.payload) and i is not None]
        first = min(copies)
        again = len(r.payload) >= 100 and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
        head, _, block = bytes(r.warc).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and f"sha256:{r.payload_digest}".encode() in head
        assert block == (b"" if again else bytes(r.payload)) + b"\r\n\r\n"
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in table})
    empty = content_archive.write_archive(spark.createDataFrame([], schema))
    assert content_archive.records(spark, empty).count() == 0


def test_archive_detects_a_changed_payload(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a", "x" * 150)], "page_id long, url string, html string")
    path = content_archive.write_archive(pages)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("y" * 150), "UTF-8")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="payload does not match"):
        content_archive.records(spark, f"{path}-2").collect()


def test_url_rules(spark):
    urls = [
        "http://Example.com/en/x", "https://www.example.com/en/", "http://m.example.com/de/", "http://a.net/es/1?q=/fr/",
        "http://a.net/es", "HTTP://notexample.com/en/", "http://com/", "http://example.com", None, "nothing", "a://b://c/en/",
        "http://xnet/es/", "http://a.NET/fr/#x", "http://a.net/fr/", "http://a.net/fr/", "http://a.example.com:80/en/", "ftp://h/\n/en/",
    ]
    schema = "page_id long, url string, host string, path string, token string, rule string, verdict string"
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h", "p", "t", "r", "v") for i, u in enumerate(urls)], schema)
    tables = [queries.URL_RULES, (*queries.URL_RULES, ("", "/es", "block"), ("", "", "allow"), ("x.y(", "/a+b/", "block"))]
    for rules in tables:
        want = collections.Counter()
        for i, u in enumerate(urls):
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
            host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
            fits = [
                (len(h + p), len(h), h + p, a)
                for h, p, a in rules
                if (h == "" or host == h or host.endswith("." + h)) and (path.startswith(p) if p else True)
            ]
            best = max(fits, default=None)
            want[(i if i != 3 else None, host, path, best[2] if best else None, best[3] if best else "allow")] += 1
        got = url_rules.judge(pages, url_rules.rule_table(spark, rules))
        assert counted(got, "page_id", "host", "path", "rule", "verdict") == want
        assert "Python" not in got._jdf.queryExecution().toString()
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, queries.URL_RULES)).count() == 0


def brute_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_metric_join(spark, monkeypatch):
    random = np.random.default_rng(3)
    base = random.normal(size=(12, 6))
    table = []
    for i in range(160):
        v = base[i % 12] + random.normal(0, 0.12, 6)
        table.append((i, v.astype(np.float32).tolist(), i % 2))
    table += [(200 + i, table[i][1], table[i][2]) for i in range(20)]
    table += [
        (300, None, 1), (301, [], 1), (302, [0.0] * 6, 0), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (304, [float("nan")] * 6, 0),
        (305, table[0][1], None), (306, [float("inf")] + [0.0] * 5, 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (None, table[3][1], 1),
    ]
    frame = spark.createDataFrame(
        [(*r, 1, True, "x") for r in table], "vec_id long, embedding array<float>, label int, n_links long, kept boolean, part string"
    )
    sound = [
        (k, np.array(v, float), lab)
        for k, (_, v, lab) in enumerate(table)
        if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = [
        (a, b)
        for a, u, k in sound
        for b, v, m in sound
        if a < b and k == m and u.size == v.size and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98
    ]
    names = brute_components(links, range(len(table)))
    degree = collections.Counter(x for pair in links for x in pair)
    least = {}
    for k, c in names.items():
        if table[k][0] is not None:
            least[c] = min(least.get(c, 1 << 40), table[k][0])
    want = collections.Counter((table[k][0], degree[k], least.get(c), table[k][0] == least.get(c)) for k, c in names.items())
    for block in (1024, 16):  # with 16, labels have several pivots and cells several parts
        monkeypatch.setattr(metric_join, "BLOCK", block)
        assert counted(metric_join.near_duplicates(frame), "vec_id", "n_links", "component_id", "kept") == want
    assert metric_join.near_duplicates(frame.limit(0)).count() == 0
    assert links


def brute_jaccard(texts, size, percent):
    sets = []
    for _, t in texts:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]
    ]
    names = brute_components(links, range(len(sets)))
    least = {}
    for k, c in names.items():
        if texts[k][0] is not None:
            least[c] = min(least.get(c, 1 << 40), texts[k][0])
    return collections.Counter((texts[k][0], len(sets[k]), least.get(c)) for k, c in names.items())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(docs, none, size, percent):
    got = jaccard_join.near_duplicates(docs, size, percent)
    assert counted(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(TEXTS, size, percent)
    assert jaccard_join.near_duplicates(none, size, percent).count() == 0


def test_jaccard_join_of_near_copies(spark, monkeypatch):
    random = np.random.default_rng(5)
    texts = []
    for family in range(4):
        base = [f"f{family}w{random.integers(50)}" for _ in range(70)]
        for _ in range(30):
            own = list(base)
            for place in random.integers(0, 70, random.integers(0, 4)):
                own[place] = f"new{random.integers(1000)}"
            texts.append((len(texts), " ".join(own[: random.integers(64, 71)])))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (512, 8):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = jaccard_join.near_duplicates(frame, 3, 80)
        assert counted(got, "doc_id", "n_shingles", "component_id") == brute_jaccard(texts, 3, 80)


def brute_repeats(texts, length, keep_first):
    seen = collections.Counter()
    raws = [(t or "").encode() for _, t in texts]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out, earlier = [], set()
    for k in sorted(range(len(texts)), key=lambda k: (texts[k][0] if texts[k][0] is not None else -1)):
        raw, end, spans = raws[k], 0, []
        for i in range(len(raw) - length + 1):
            part = raw[i : i + length]
            if seen[part] > 1 and (not keep_first or part in earlier):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
            earlier.add(part)
        kept = bytearray()
        for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)], strict=True):
            kept += raw[a:b]
        out.append((texts[k][0], len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


SHORTER = [(i, t if t is None or len(t) < 20_000 else t[:6000]) for i, t in TEXTS]


@pytest.mark.parametrize(("length", "group"), [(200, 256), (40, 1), (40, 256), (7, 2)])
def test_suffix_dedup(spark, none, length, group):
    docs = spark.createDataFrame(rows(SHORTER), DOCS).repartition(3)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert counted(suffix_dedup.report(docs, length, group=group), *columns) == brute_repeats(SHORTER, length, False)
    single = list(dict.fromkeys(SHORTER))
    once = spark.createDataFrame(rows(single), DOCS)
    assert counted(suffix_dedup.report(once, length, True, group=group), *columns) == brute_repeats(single, length, True)
    assert suffix_dedup.report(none, length).count() == 0


def test_suffix_dedup_gives_spans_and_texts(spark):
    frame = spark.createDataFrame([(1, "x" * 5 + PASSAGE), (2, PASSAGE + "tail")], "doc_id long, text string")
    spans = suffix_dedup.removed_spans(frame, 50).collect()
    assert [(r.doc_id, r.begin, r.end) for r in spans] == [(2, 0, len(PASSAGE))]
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.deduplicated(frame, 50).collect()} == {1: b"x" * 5 + PASSAGE.encode(), 2: b"tail"}


def test_suffix_dedup_works_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    docs = spark.createDataFrame(rows(SHORTER), DOCS)
    got = counted(suffix_dedup.report(docs, 40), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(SHORTER, 40, False)


def test_longest_previous_factors_of_one_text():
    random = np.random.default_rng(1)
    for _ in range(50):
        text = bytes(random.integers(97, 99, random.integers(1, 40)).tolist())
        order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        before, after = suffix_dedup.factor_sources(order, np.arange(order.size) == 0)
        for k, i in enumerate(order):
            smaller = [j for j in range(k) if order[j] < i]
            larger = [j for j in range(k + 1, order.size) if order[j] < i]
            assert before[k] == (smaller[-1] if smaller else -1) and after[k] == (larger[0] if larger else -1)


def test_cross_entropy(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = cross_entropy.differences(docs, cross_entropy.fit(docs, labels)).collect()
    raws = [(i, b"\0\0" + (t or "").encode() + b"\0") for i, t in TEXTS]
    target, every = collections.Counter(), collections.Counter()
    for i, raw in raws:
        grams = [raw[j : j + 3] for j in range(len(raw) - 2)]
        every.update(grams)
        if i in (1, 2, 8):
            target.update(grams)
    size = len({b for g in every for b in g} | {0}) + 1
    share = sum(target.values()) / sum(every.values())
    models = []
    for counts, scale in ((target, 1.0), (every, share)):
        one, two, pre, uni = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
        for g, n in counts.items():
            one[g[2]] += n * scale
            two[g[1:]] += n * scale
            pre[g[:2]] += n * scale
            uni[g[1]] += n * scale
        total = sum(one.values())
        models.append((counts, scale, one, two, pre, uni, total))

    def loss(model, g):
        counts, scale, one, two, pre, uni, total = model
        p = (one[g[2]] + 1) / (total + size)
        p = (two[g[1:]] + 4 * p) / (uni[g[1]] + 4)
        p = (counts[g] * scale + 4 * p) / (pre[g[:2]] + 4)
        return -np.log2(p)

    want = collections.defaultdict(list)
    for i, raw in raws:
        grams = collections.Counter(raw[j : j + 3] for j in range(len(raw) - 2))
        n = sum(grams.values())
        near, far = (sum(k * loss(m, g) for g, k in grams.items()) / n for m in models)
        want[i].append((n, near, far, near - far))
    for r in got:
        assert any(np.allclose(w, (r.n_tokens, r.target_loss, r.background_loss, r.score), atol=1e-9) for w in want[r.doc_id])
    assert len(got) == len(TEXTS)
    assert cross_entropy.differences(none, cross_entropy.fit(none, labels)).count() == 0
    assert cross_entropy.differences(docs, cross_entropy.fit(docs, labels.limit(0))).count() == len(TEXTS)


def test_pieces(docs, none):
    path = queries.tokenizer_path()
    got = pieces.encoding_report(docs, path, n=3).collect()
    assert len(got) == len(TEXTS) and all(r.round_trip for r in got)
    coded = pieces.encoded(docs, path, ("doc_id", "size"))
    back = pieces.decoded(coded, path, ("doc_id",))
    assert counted(back, "doc_id", "text") == collections.Counter((i, t or "") for i, t in TEXTS)
    assert pieces.encoding_report(none, path).count() == 0


def test_n_best_of_a_lattice():
    read = pieces.read_model(queries.tokenizer_path())
    vocabulary = pieces.Vocabulary(*read)
    edges = {piece: (score, i) for i, (piece, score) in enumerate(read[0]) if piece}
    random = np.random.default_rng(2)

    def all_paths(unit):
        found = []

        def walk(i, ids, score):
            if i == len(unit):
                found.append((score, tuple(ids)))
                return
            single = False
            for k in range(i + 1, len(unit) + 1):
                edge = edges.get(unit[i:k])
                if edge:
                    single = single or k == i + 1
                    walk(k, [*ids, edge[1]], score + edge[0])
            if not single:
                walk(i + 1, [*ids, *vocabulary.spelt(unit[i])], score + vocabulary.unknown)

        walk(0, [], 0.0)
        return sorted(found, key=lambda f: -f[0])

    for _ in range(100):
        unit = "▁" + "".join(random.choice(list("theranionsé\n漢"), random.integers(1, 8)))
        want = all_paths(unit)
        got = vocabulary.n_best(unit, 4)
        assert [g[0] for g in got] == [w[0] for w in want[:4]] and len({g[1] for g in got}) == len(got)
        best, lost, ids = vocabulary.best(unit)
        assert (best, ids) == got[0] and (lost == best - want[1][0] if len(want) > 1 else lost == np.inf)
    for _ in range(50):
        text = " ".join("".join(random.choice(list("theran"), random.integers(1, 4))) for _ in range(3))
        encoder = pieces.Encoder(vocabulary)
        got = encoder.segmentations(text, 6)
        want = all_paths("▁" + text.replace(" ", "▁"))
        assert [g[0] for g in got] == [w[0] for w in want[:6]] == encoder.encode(text, 6)[1]
        assert all(vocabulary.decode(g[1]) == text for g in got) and len({tuple(g[1]) for g in got}) == len(got)


@pytest.mark.parametrize("text", ["", " ", "  a", "▁", "a ▁ b▁", "\x00\n\t", "x" * 5000, "é 漢 😀", " ▁"])
def test_every_text_decodes(text):
    vocabulary = pieces.Vocabulary(*pieces.read_model(queries.tokenizer_path()))
    assert vocabulary.decode(pieces.Encoder(vocabulary).encode(text)[0]) == text


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scores(none, model).count() == 0
    assert toxicity.keep_clean(docs, model, 2.0).columns == docs.columns
    without = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.scores(docs, without).collect()} == {0.0}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scores.items())
    held = [(scores[i].predicted, y) for i, y in labels.items() if scores[i].held_out]
    caught = sum(p for p, y in held if y == 1) / sum(y == 1 for _, y in held)
    blamed = sum(p for p, y in held if y == 0) / sum(y == 0 for _, y in held)
    assert caught >= 0.6 and blamed <= 0.08


def test_misspelt_words_are_toxic(spark):
    clean = [f"the plain words of number {i} are kind and calm today".split() for i in range(40)]
    bad = [w[:4] + ["idiotic" if i % 2 else "worthless"] + w[4:] for i, w in enumerate(clean)]
    texts = [[x.encode() for x in w] for w in clean + bad]
    model = toxicity.fit(texts, np.repeat([0, 1], 40))
    scorer = toxicity.Scorer(model)
    for text, toxic in (("some kind worthles words", 1), ("an idiotik day", 1), ("the calm words are kind", 0)):
        assert (model.probability(np.array([scorer.logit(text)]))[0] >= 0.7) == bool(toxic)
