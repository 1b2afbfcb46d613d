"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host and the beginning of a path, and allows or blocks. It fits its
host and all subdomains when the path of the URL starts with its own; an empty
host fits every host. Tokens of a URL are the labels of its host and the
segments of its path; literal tokens of a rule are those that every URL it fits
must have: its labels, and its segments that a slash ends. Each rule is indexed
by the one of them that the fewest different URLs have. URLs fetch the rules
under their tokens by a join, and only fetched rules run their regular
expression. A rule without such a token is fetched by every URL.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A
to Z lower-cased; the path follows up to `?`, `#` or the end. A null URL or one
without `://` has both empty and is judged as such. Of fitting rules the longest
(host and path together) wins, of equally long ones that with the longer host,
then the greatest by code point, `block` before `allow`. Without one the verdict
is the default and the rule null. Different hosts and paths are judged once, so
repeated URLs cost a light join. Rows keep their number: repeated pages are
judged alike, a null page id stays null. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.shared import ascii_lower

ALLOW, BLOCK = "allow", "block"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, action)."""
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _marked(parts: Column, mark: str) -> Column:
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_marked(F.split(host, r"\."), "h:"), _marked(F.split(path, "/"), "p:")))


def _pattern(host: Column, path: Column) -> Column:
    def literal(x: Column) -> Column:
        return F.regexp_replace(x, r"([^A-Za-z0-9])", r"\\$1")

    begin = F.when(host == "", F.lit("^[^/]*")).otherwise(F.concat(F.lit(r"^(?:[^/]*\.)?"), literal(host)))
    return F.concat(begin, F.when(path == "", F.lit("(?:/|$)")).otherwise(literal(path)))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with the token they are found by; `urls` has the tokens of different URLs, one a row."""
    clean = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.coalesce("action", F.lit(ALLOW)).alias("action"),
    ).distinct()
    whole_segments = F.regexp_extract(F.col("r_path"), r"(?s)^(.*/)", 1)
    tokens = clean.select("*", F.explode_outer(_tokens(F.col("r_host"), whole_segments)).alias("token"))
    counts = (
        urls.join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
    return (
        tokens.join(counts, "token", "left")
        .groupBy("r_host", "r_path", "action")
        .agg(rarest.alias("best"))
        .select(
            "r_host",
            "r_path",
            "action",
            F.col("best.token").alias("token"),
            F.concat("r_host", "r_path").alias("rule"),
            _pattern(F.col("r_host"), F.col("r_path")).alias("pattern"),
        )
    )


def judge(
    pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    places = rows.select("host", "path").distinct()
    # the empty token fetches the rules that have none of their own
    tokens = places.select(
        "host", "path", F.explode(F.concat(F.array(F.lit("")), _tokens(F.col("host"), F.col("path")))).alias("token")
    )
    index = indexed(rules, tokens.select("token"))
    fits = F.regexp_like(F.concat("host", "path"), F.col("pattern"))
    best = F.max(
        F.struct(F.length("rule").alias("n"), F.length("r_host").alias("m"), "rule", "action")
    )
    verdicts = (
        tokens.join(index, "token")
        .filter(fits)
        .groupBy(F.col("host").alias("v_host"), F.col("path").alias("v_path"))
        .agg(best.alias("best"))
    )
    return rows.join(
        verdicts, (F.col("host") == F.col("v_host")) & (F.col("path") == F.col("v_path")), "left"
    ).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
