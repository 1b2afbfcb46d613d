"""Similarity join of documents by the Jaccard index of their word shingles, with adaptive multi-match prefixes.

All shingles have one global order. Two sets that are similar enough share at
least L shingles among the first n - ceil(t n) + L of each, for any L up to the
least overlap: the L-prefix. A longer prefix looks at more shingles but asks for
L matches, so fewer candidates have to be verified. Each document takes the L
with the least estimated cost: the documents that its prefix reaches, and, as L
matches share a candidate, an L-th of them to verify. A pair needs as many
matches as the smaller L of both. A document whose prefix of any L has fewer
than L shingles that others have too is similar to none, and most end there.

The order: first a sample of the shingles, chosen by hash, by their document
frequency, rare ones first; then the others by hash; last the most frequent ones
of the corpus, at most `FREQUENT`, found by counts over all documents. So exact
frequencies are needed for the sample only, which holds 1.5 times as many
shingles as a prefix does. A document with too few sampled ones adds the first of
the others. Any order gives the same result; this one keeps lists short.

Documents with equal sets are one from the start. Groups of near copies emit no
pairs: each document names the one that is the least member of most lists of its
prefix shingles, and what names each other is a cluster. Within a cluster blocks
of sets are compared by matrix products, and each block gives a spanning forest
of its links. Between clusters candidates are paired by their prefixes and
verified one by one, so no link that joins components is lost.

Words are runs of other than white space, A to Z lower-cased. A text of fewer
words than a shingle has is one shingle; null texts and texts without words have
none and are alone. Shingles are compared by 64-bit hashes. Ids may repeat: rows
with one id and unlike texts are told apart, and all rows of a component get its
least id, null only if no row has one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components, spanning_forest
from tallyspark.llm.shared import rows_of, small, stored, text_or_empty, unused

MOST_MATCHES = 4
SURPLUS = 1.5
VERIFY_COST = 8.0
BLOCK = 512
FREQUENT = 1 << 17
COUNTED_TOGETHER, COUNTED_FROM = 3000, 3
DENSE = 32
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Different shingle hashes of a text, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(size, len(words))
    value = np.full(len(words) - span + 1, 0 if span == size else span, np.uint64)
    for i in range(span):
        value = value * STEP + h[i : len(words) - span + 1 + i]
    return np.unique(mixed(value).view(np.int64))


def _sampled(tokens: np.ndarray, percent: int) -> np.ndarray:
    share = min(1.0, SURPLUS * (100 - percent) / 100)
    return (tokens & 1023) < round(1024 * share)


def prefix_length(n: int, percent: int, matches: int) -> int:
    return min(n, n - -(-percent * n // 100) + matches)


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles, ascending; all documents are counted, in parts, and parts leave out their rare ones."""

    def counted(own: list[np.ndarray]) -> pd.DataFrame:
        tokens, n = np.unique(np.concatenate(own), return_counts=True)
        return pd.DataFrame({"token": tokens[n >= COUNTED_FROM], "n": n[n >= COUNTED_FROM]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[np.ndarray] = []  # a part is as large whatever the batches are
        for rows in batches:
            for text in rows["text"]:
                own.append(shingles(text, size))
                if len(own) == COUNTED_TOGETHER:
                    yield counted(own)
                    own = []
        if own:
            yield counted(own)

    counts = texts.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    first = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()
    return np.sort(first["token"].to_numpy(np.int64))


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document: doc_id, set_a and set_b (a 128-bit digest), n, n_sampled, tokens.

    The tokens are all sampled shingles, and others in their order up to the longest prefix.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = sent.value
        for rows in rows_of(batches, 1000):
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                own = shingles(text, size)
                late = np.zeros(own.size, bool)
                if frequent.size:
                    late = frequent[np.minimum(np.searchsorted(frequent, own), frequent.size - 1)] == own
                chosen = _sampled(own, percent) & ~late
                first = own[chosen]
                others = np.concatenate([own[~chosen & ~late], own[late]])
                more = prefix_length(own.size, percent, MOST_MATCHES) - first.size if own.size else 0
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                out.append(
                    (doc_id, digest[0], digest[1], own.size, first.size, np.concatenate([first, others[: max(0, more)]]))
                )
            yield pd.DataFrame(out, columns=["doc_id", "set_a", "set_b", "n", "n_sampled", "tokens"]).astype(
                {"doc_id": rows["doc_id"].dtype}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(
        build, f"doc_id {kind}, set_a long, set_b long, n int, n_sampled int, tokens array<long>"
    )


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(batches, 500):
            own = [shingles(t, size) for t in rows["text"]]
            digests = [np.frombuffer(xxhash.xxh3_128_digest(o.tobytes()), np.int64) for o in own]
            yield pd.DataFrame({"set_a": [d[0] for d in digests], "set_b": [d[1] for d in digests], "own": own})

    return docs.select("text").mapInPandas(build, "set_a long, set_b long, own array<long>")


def chosen_prefix(
    token: np.ndarray, place: np.ndarray, df: np.ndarray, n: int, n_sampled: int, percent: int
) -> tuple[int, np.ndarray]:
    """The number of matches asked for and the shingles of that prefix; none if there can be no partner.

    Given are the listed shingles that several sets have, with their frequency; `place` is
    the place in the global order of those outside the sample and -1 for the others.
    """
    late = place >= 0
    order = np.lexsort((token, np.where(late, place, df), late))
    token, place, df, late = token[order], place[order], df[order], late[order]
    # sampled shingles that no other set has come first
    at = np.where(late, place, n_sampled - (~late).sum() + np.arange(token.size))
    overlap = -(-percent * n // 100)
    reached = np.cumsum(df)
    best = (np.inf, 0, 0)
    for matches in range(1, min(MOST_MATCHES, overlap) + 1):
        k = int(np.searchsorted(at, n - overlap + matches))
        if k < matches:
            return 0, token[:0]
        best = min(best, (reached[k - 1] * (1 + VERIFY_COST / matches), matches, k))
    return best[1], token[: best[2]]


def _prefixes(listed: DataFrame, percent: int) -> DataFrame:
    """The prefix of each set that may have a partner: rid, n, matches, token."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(batches, 1000):
            out = []
            for rid, n, n_sampled, token, place, df in rows.itertuples(index=False, name=None):
                matches, tokens = chosen_prefix(np.asarray(token), np.asarray(place), np.asarray(df), n, n_sampled, percent)
                if matches:
                    out.append((rid, n, matches, tokens))
            yield pd.DataFrame(out, columns=["rid", "n", "matches", "tokens"])

    chosen = listed.mapInPandas(choose, "rid long, n int, matches int, tokens array<long>")
    return chosen.select("rid", "n", "matches", F.explode("tokens").alias("token"))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard index reaches the threshold."""
    left = sets.select(F.col("rid").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("rid").alias("b"), F.col("own").alias("own_b"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    union = F.size("own_a") + F.size("own_b") - shared
    return pairs.join(left, "a").join(right, "b").filter(shared * 100 >= union * percent).select("a", "b")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists.

    Shingles that many sets of both lists have are counted by a matrix product, the others
    pair by pair, so the work is bounded by the shingles given, whatever repeats.
    """
    tokens = [np.concatenate(x) for x in (a, b)]
    owners = [np.repeat(np.arange(len(x)), [s.size for s in x]) for x in (a, b)]
    common = np.intersect1d(tokens[0], tokens[1])
    columns = []
    for i in (0, 1):
        place = np.searchsorted(common, tokens[i])
        held = place < common.size
        held[held] = common[place[held]] == tokens[i][held]
        order = np.argsort(place[held], kind="stable")
        columns.append((place[held][order], owners[i][held][order]))
    counts = [np.bincount(c, minlength=common.size) for c, _ in columns]
    dense = (counts[0] >= DENSE) & (counts[1] >= DENSE)
    found = np.zeros((len(a), len(b)), np.int64)
    rank = np.cumsum(dense) - 1
    total = int(dense.sum())
    for begin in range(0, total, 2048):
        grids = []
        for (place, owner), size in zip(columns, (len(a), len(b)), strict=True):
            grid = np.zeros((size, min(2048, total - begin)), np.float32)
            mine = dense[place] & (rank[place] >= begin) & (rank[place] < begin + 2048)
            grid[owner[mine], rank[place[mine]] - begin] = 1
            grids.append(grid)
        found += np.rint(grids[0] @ grids[1].T).astype(np.int64)
    starts = np.cumsum(counts[1]) - counts[1]
    place, owner = columns[0]
    rare = ~dense[place]
    place, owner = place[rare], owner[rare]
    times = counts[1][place]
    left = np.repeat(owner, times)
    offsets = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    right = columns[1][1][np.repeat(starts[place], times) + offsets]
    return found + np.bincount(left * len(b) + right, minlength=found.size).reshape(found.shape)


def _within(percent: int):
    """Links within clusters: each part has some sets of its cluster, and streams through those that come after them."""

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, own = None, np.zeros(0, np.int64), []
        for batch in batches:
            keys = batch["part"].to_numpy()
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for begin, end in zip(edges, np.append(edges[1:], len(batch)), strict=True):
                if keys[begin] != key:
                    key, ids, own = keys[begin], np.zeros(0, np.int64), []
                rows = batch.iloc[begin:end]
                side = rows["side"].to_numpy()
                homes, others = rows[side == 0], rows[side == 1]
                ids = np.concatenate([ids, homes["rid"].to_numpy()])
                own += list(homes["own"])
                for i in range(0, len(others), BLOCK):
                    tile = others.iloc[i : i + BLOCK]
                    tile_ids, tile_own = tile["rid"].to_numpy(), list(tile["own"])
                    shared = intersections(own, tile_own)
                    union = np.array([s.size for s in own])[:, None] + np.array([s.size for s in tile_own])[None, :] - shared
                    a, b = spanning_forest(shared * 100 >= union * percent, ids, tile_ids)
                    keep = a != b
                    if keep.any():
                        yield pd.DataFrame({"a": a[keep], "b": b[keep]})

    return within


def _cluster_links(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Edges that connect what is similar within a cluster; `clusters` has node and component."""
    parts = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    number = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    numbered = stored(clusters.join(parts, "component").select("node", "component", number.alias("number")), "jaccard-numbered")
    placed = sets.join(small(numbered), F.col("node") == F.col("rid"))
    # a set is at home in its own part and passes through those up to it
    entries = F.concat(
        F.array(F.struct(F.col("number").alias("at"), F.lit(0).alias("side"))),
        F.transform(F.sequence(F.lit(0), F.col("number")), lambda x: F.struct(x.alias("at"), F.lit(1).alias("side"))),
    )
    spread = placed.select("component", "rid", "own", F.explode(entries).alias("e")).select(
        F.concat_ws("/", "component", "e.at").alias("part"), "e.side", "rid", "own"
    )
    return spread.repartition("part").sortWithinPartitions("part", "side").mapInPandas(_within(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Sets link when 100 * intersection >= percent * union."""
    return _grouped(docs, size, percent, id_column, text_column).select("doc_id", "n_shingles", "component_id")


def deduplicate(
    docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each component, with its own columns: that with the least id, ids before null, then the least set.

    Rows without words all stay. An id that several rows bear does not tell which
    of them is meant: there the sets do, and of rows alike in id and set one stays.
    """
    groups = stored(_grouped(docs, size, percent, id_column, text_column), "jaccard-members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_a", "set_b")
    least = groups.filter("part IS NOT NULL").groupBy("part").agg(F.min(order).alias("least")).select("least.*").drop("no_id")
    least = stored(least, "jaccard-least")
    id_name, rows_name, text_name, of = (unused(docs.columns, f"_near_{c}") for c in ("id", "rows", "text", "of"))
    borne = groups.groupBy("doc_id").agg(F.count("*").alias(rows_name), F.count("part").alias("filled"))
    meant = least.select(F.col("doc_id").alias("least_id")).distinct().withColumn("meant", F.lit(True))
    borne = borne.join(meant, F.col("doc_id").eqNullSafe(F.col("least_id")), "left")
    stays = F.col("meant").isNotNull() | (F.col("filled") < F.col(rows_name))
    borne = borne.select(F.col("doc_id").alias(id_name), rows_name, stays.alias("stays"))
    # few ids go or are borne by several rows, so the texts of the others stay where they are
    odd = stored(borne.filter(~F.col("stays") | (F.col(rows_name) > 1)), "jaccard-odd")
    ids = odd.filter("stays").drop("stays")
    this_id = F.col(f"`{id_column}`")
    single = docs.join(small(odd.select(id_name)), this_id.eqNullSafe(F.col(id_name)), "left_anti")

    text = text_or_empty(f"`{text_column}`")
    several = docs.join(small(ids), this_id.eqNullSafe(F.col(id_name)), "left_semi")
    several = several.withColumn(text_name, F.md5(text))
    sets = stored(_digests(several.select(F.col(text_name).alias("content"), text.alias("text")), size).distinct(), "jaccard-several")
    empty = several.join(sets.filter("n = 0").select(F.col("content").alias(of)), F.col(text_name) == F.col(of), "left_semi")
    named = sets.filter("n > 0").select("content", F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    kept = named.join(least, (F.col("a") == F.col("set_a")) & (F.col("b") == F.col("set_b"))).groupBy("doc_id", "set_a", "set_b").agg(
        F.min("content").alias("content")  # of unlike texts with one set under one id, one
    )
    found = several.join(
        kept.select(F.col("content").alias(of), F.col("doc_id").alias(id_name)),
        (F.col(text_name) == F.col(of)) & this_id.eqNullSafe(F.col(id_name)),
    )
    found = found.dropDuplicates([id_name, text_name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.unionByName(empty.select(*columns)).unionByName(found.select(*columns))


def _digests(texts: DataFrame, size: int) -> DataFrame:
    """Digest and number of shingles of each row's text, with its `content`."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(batches, 500):
            own = [shingles(t, size) for t in rows["text"]]
            digests = [np.frombuffer(xxhash.xxh3_128_digest(o.tobytes()), np.int64) for o in own]
            yield pd.DataFrame(
                {"content": rows["content"].tolist(), "set_a": [d[0] for d in digests], "set_b": [d[1] for d in digests], "n": [o.size for o in own]}
            )

    return texts.mapInPandas(build, "content string, set_a long, set_b long, n long")


def _grouped(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """The rows of `near_duplicates`, with the digest of their set and the key of their component, null without words."""
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_or_empty(f"`{text_column}`").alias("text"))
    rows = stored(_sets(texts, size, percent).withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")
    filled = rows.filter("n > 0")
    # one row of each set, found before anything is paired
    groups = stored(
        filled.groupBy("set_a", "set_b").agg(F.min("sid").alias("rid"), F.min("doc_id").alias("least_id")), "jaccard-groups"
    )
    one = filled.groupBy("set_a", "set_b").agg(F.min_by(F.struct("sid", "n_sampled", "tokens"), "sid").alias("r"))
    tokens = one.select(
        F.col("r.sid").alias("rid"), F.col("r.n_sampled").alias("n_sampled"), F.posexplode("r.tokens").alias("i", "token")
    ).select("rid", "token", F.when(F.col("i") < F.col("n_sampled"), F.lit(-1)).otherwise(F.col("i")).alias("place"))
    common = tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    common = stored(common, "jaccard-common")  # apart from the join, whose hot shingles can then be split
    lists = tokens.join(common, "token").groupBy("rid").agg(F.collect_list(F.struct("token", "place", "df")).alias("x"))
    listed = lists.join(filled.select("sid", "n", "n_sampled"), F.col("rid") == F.col("sid")).select(
        "rid", "n", "n_sampled", "x.token", "x.place", "x.df"
    )
    prefixes = stored(_prefixes(listed, percent), "jaccard-prefixes")
    hubs = prefixes.groupBy("token").agg(F.min(F.struct("rid", "n")).alias("hub"), F.count("*").alias("k")).filter("k > 1")
    prefixes = stored(prefixes.join(hubs, "token").select("token", "rid", "n", "matches", "hub"), "jaccard-lists")

    # sets are clustered by the one that most of their prefix shingles name, and compared within a cluster
    named = (
        prefixes.filter((F.col("rid") != F.col("hub.rid")) & _sizes_fit(F.col("n"), F.col("hub.n"), percent))
        .groupBy(F.col("rid").alias("a"), F.col("hub.rid").alias("b"))
        .agg(F.count("*").alias("times"))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))
    )
    clusters = stored(components(named), "jaccard-clusters")
    wanted = prefixes.select("rid").distinct()
    chosen = filled.select("sid", "doc_id", "set_a", "set_b").join(wanted, F.col("sid") == F.col("rid"))
    chosen = stored(chosen.select("rid", F.col("doc_id").alias("wanted_id"), "set_a", "set_b"), "jaccard-chosen")
    ids = small(chosen).select("wanted_id").distinct()
    own = _full_sets(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi"), size)
    # rows that repeat an id may give a set twice, which changes nothing
    sets = stored(own.join(small(chosen).select("rid", "set_a", "set_b"), ["set_a", "set_b"]).select("rid", "own"), "jaccard-full")
    links = stored(_cluster_links(sets, clusters, percent), "jaccard-links")

    # then candidates from different clusters: those of a list that has several
    placed = stored(
        prefixes.join(clusters, F.col("rid") == F.col("node"), "left").select(
            "token", "rid", "n", "matches", F.coalesce("component", "rid").alias("part")
        ),
        "jaccard-parts",
    )
    parts = placed.select("token", "part").distinct()
    several = parts.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    parts = parts.join(several, "token", "left_semi")
    across = (
        parts.select("token", F.col("part").alias("part_a"))
        .join(parts.select("token", F.col("part").alias("part_b")), "token")
        .filter("part_a < part_b")
    )
    side = [
        placed.select("token", F.col("part").alias(f"part_{s}"), F.col("rid").alias(s), F.col("n").alias(f"n_{s}"), F.col("matches").alias(f"matches_{s}"))
        for s in "ab"
    ]
    candidates = (
        across.join(side[0], ["token", "part_a"])
        .join(side[1], ["token", "part_b"])
        .filter(_sizes_fit(F.col("n_a"), F.col("n_b"), percent))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.min(F.least("matches_a", "matches_b")).alias("needed"))
        .filter("shared >= needed")
        .select("a", "b")
    )
    candidates = stored(candidates, "jaccard-candidates")
    sides = stored(candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "jaccard-sides")
    more = _verified(candidates, sets.join(small(sides), "rid", "left_semi"), percent)
    whole = stored(components(links.unionByName(more)), "jaccard-components")

    least = (
        groups.join(whole, F.col("rid") == F.col("node"), "left")
        .select("set_a", "set_b", "least_id", F.coalesce("component", "rid").alias("part"))
    )
    names = least.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named_sets = least.join(names, "part").select("set_a", "set_b", "component_id", "part")
    linked = filled.select("doc_id", "n", "set_a", "set_b").join(named_sets, ["set_a", "set_b"])
    names = [F.col("n").cast("long").alias("n_shingles"), "component_id", "set_a", "set_b", "part"]
    alone = rows.filter("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        "set_a", "set_b", F.lit(None).cast("long").alias("part"),
    )
    return linked.select("doc_id", *names).unionByName(alone)
