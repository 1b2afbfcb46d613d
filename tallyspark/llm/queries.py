"""The queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import content_archive, cover_tree, exact_dedup, jaccard_join, metric_join, neighbour_graph, pieces, source_mix, suffix_dedup, token_alignment, toxicity, url_rules, word_models
from tallyspark.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer, as the installed package of them names it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query(
    "op3_content_archive",
    """
    WITH f AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    g AS (SELECT d, min(page_id) AS first_id FROM f GROUP BY d)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f JOIN g USING (d)
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path = content_archive.write_archive(table(spark, folder, "pages"), least=100)
    return content_archive.records(spark, path).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


@query(
    "op4_url_rules",
    r"""
    WITH r(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
        ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    u AS (SELECT page_id,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
    best AS (SELECT host, path, max({'n': length(h || p), 'rule': h || p, 'action': action}) AS b
        FROM (SELECT DISTINCT host, path FROM u)
        JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
    SELECT page_id, u.host, u.path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict
    FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), url_rules.rule_table(spark, URL_RULES))


@query(
    "op7_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cps,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cps DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.groups_of(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op9_source_mix",
    r"""
    WITH z AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
    r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
        3 * source_size AS cap FROM s),
    o AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS wanted, (sum(w) OVER ())::BIGINT AS all_w,
        coalesce(sum(cap) OVER q, 0)::BIGINT AS caps_before, coalesce(sum(w) OVER q, 0)::BIGINT AS w_before FROM r
        WINDOW q AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT min({'b': w_before, 'left': wanted - caps_before, 'open': all_w - w_before}) AS v FROM o
        WHERE (wanted - caps_before) * w <= cap * (all_w - w_before)),
    t AS (SELECT source, source_size, CASE WHEN v IS NOT NULL AND w_before >= v.b
        THEN (w * v.left)::DOUBLE / v.open::DOUBLE ELSE cap::DOUBLE END AS target FROM o, l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
    x AS (SELECT z.*, e.source_size, e.target, e.whole, round(target - whole * e.source_size)::BIGINT AS rest,
        coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY place, doc_id NULLS LAST, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM z JOIN e ON z.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, whole * size + least(greatest(rest - before, 0), size) AS taken FROM x
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    taken = source_mix.mix(table(spark, folder, "documents"), weights=(5, 2, 1), max_epochs=3)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), learn_from=~toxicity.held_out(F.col("doc_id")))
    return toxicity.scores(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op2_cross_entropy")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return word_models.differences(docs, table(spark, folder, "labels").filter("quality = 1"))


@query("op6_pieces")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    report = pieces.encoding_report(table(spark, folder, "documents"), tokenizer_path(), n=3, cached_units=200_000)
    return report.select(
        "doc_id",
        "n_pieces",
        F.get("scores", F.lit(0)).alias("best_score"),
        F.get("scores", F.lit(1)).alias("second_score"),
        F.get("scores", F.lit(2)).alias("third_score"),
        "pieces_sha256",
        F.get("all_sha256", F.lit(1)).alias("second_sha256"),
        F.get("all_sha256", F.lit(2)).alias("third_sha256"),
        "round_trip",
        F.get("all_round_trip", F.lit(1)).alias("second_round_trip"),
        F.get("all_round_trip", F.lit(2)).alias("third_round_trip"),
    )


@query("op8_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"), size=3, percent=90)


@query("op5_metric_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, folder, "embeddings"), cosine=0.98)


@query("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.report(table(spark, folder, "documents"), length=200, keep_first=False)


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.report(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


@query(
    "op12_hard_negatives",
    """
    WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT a.vec_id AS anchor_id, a.v, a.label, b.vec_id AS positive_id, list_dot_product(a.v, b.v)::BIGINT AS s
        FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, s, c.vec_id AS negative_id, list_dot_product(p.v, c.v)::BIGINT AS t
        FROM p JOIN v c ON p.label <> c.label)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY t DESC, negative_id)::INT AS rank,
        negative_id, s AS positive_score, t AS negative_score
    FROM n WHERE 80 * s <= 100 * t AND 100 * t <= 100 * s QUALIFY rank <= 5
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cover_tree.taking_part(table(spark, folder, "embeddings"), 256, "vec_id", "embedding", label)
    return cover_tree.mine(rows, F.col("id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)
