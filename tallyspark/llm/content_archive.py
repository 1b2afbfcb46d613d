"""Content-addressed WARC archive.

The bytes of a payload are stored once, under their SHA-256; the exact header of
every record is stored apart from it. Two Parquet tables make an archive:

* `payloads`: digest, payload
* `headers`: page_id, digest, header (all lines of the record's header, CRLF
  ended, without the empty line that ends it)

`records` joins them and gives back the original records, those of revisits with
the payload they refer to, and `warc_bytes` writes a record as it stands in a
file. Every payload read is hashed again and measured against its header; a
mismatch stops the job.

Of records with equal payloads of at least `least` bytes, the one with the
smallest page id is a response and the others revisit it. Shorter payloads are
all responses, though stored once too. Null payloads are empty. Null ids come
after all others; rows that repeat an id with the same payload get the same
record type. Line ends inside a URL are percent-encoded in the header, a null
URL leaves its line out. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.shared import stored, text_or_empty
from tallyspark.session import new_path

CRLF = "\r\n"
RESPONSE, REVISIT = "response", "revisit"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def header_text(date: str) -> Column:
    """The header of a record from page_id, url, digest, n_bytes and first_id (null for a response)."""
    revisit = F.col("first_id").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit(REVISIT)).otherwise(F.lit(RESPONSE))),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD))),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id")))),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
    )


def write_archive(
    pages: DataFrame,
    least: int = 100,
    date: str = "1970-01-01T00:00:00Z",
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    path: str | None = None,
) -> str:
    """Archive all pages and return the archive's folder."""
    path = path or new_path(pages.sparkSession, "archive")
    payload = F.encode(text_or_empty(payload_column), "UTF-8")
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    facts = stored(
        source.select(
            "page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes")
        ),
        "archive-facts",
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "n_rows")
    firsts = (
        facts.groupBy("digest", "page_id")
        .agg(F.count("*").alias("n_rows"), F.max("n_bytes").alias("n_bytes"))
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.max("n_bytes").alias("most"), F.min("n_bytes").alias("fewest"))
        .select(
            "digest",
            F.col("first.page_id").alias("keep_id"),
            F.col("first.n_rows").alias("n_rows"),
            F.when(F.col("most") == F.col("fewest"), F.col("most"))
            .otherwise(F.raise_error(F.lit("payloads of unlike length share a digest")).cast("long"))
            .alias("length"),
        )
    )
    firsts = stored(firsts, "archive-firsts")

    first_id = F.when((F.col("length") >= least) & ~F.col("page_id").eqNullSafe(F.col("keep_id")), F.col("keep_id"))
    headers = facts.join(firsts, "digest").withColumn("first_id", first_id)
    headers.select("page_id", "digest", header_text(date).alias("header")).write.parquet(f"{path}/headers")

    # one row of each payload is found by its page; the digest is taken again from the very bytes that are stored
    keepers = firsts.select("keep_id", F.col("digest").alias("keep_digest"), "n_rows")
    kept = source.select("page_id", "payload", F.sha2("payload", 256).alias("digest")).join(
        keepers, F.col("page_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    )
    once = kept.filter("n_rows = 1").select("digest", "payload")
    repeated = kept.filter("n_rows > 1").select("digest", "payload").dropDuplicates(["digest"])
    once.unionByName(repeated).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def field(name: str) -> Column:
    """A field of a header, null where the header lacks it."""
    value = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.when(value != "", value)


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive: page_id, header, payload, payload_digest, record_type, refers_to."""
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("stored_digest"), "payload")
    headers = spark.read.parquet(f"{path}/headers").select(
        "page_id",
        "header",
        field("WARC-Type").alias("record_type"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("digest"),
        F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("target"),
        field("Content-Length").cast("long").alias("length"),
    )
    verified = (F.sha2("payload", 256) == F.col("digest")) & (
        (F.col("record_type") == REVISIT) | (F.octet_length("payload") == F.col("length"))
    )
    return headers.join(payloads, F.col("digest") == F.col("stored_digest"), "left").select(
        "page_id",
        "header",
        "payload",
        F.when(F.coalesce(verified, F.lit(False)), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match its record: "), "digest")))
        .alias("payload_digest"),
        "record_type",
        F.when(F.col("target") != "", F.col("target").cast("long")).alias("refers_to"),
    )


def warc_bytes() -> Column:
    """A record as it stands in a WARC file; the block of a revisit is empty."""
    block = F.when(F.col("record_type") == REVISIT, F.lit(b"")).otherwise(F.col("payload"))
    line_end = F.encode(F.lit(CRLF), "UTF-8")
    return F.concat(F.encode("header", "UTF-8"), line_end, block, line_end, line_end)
