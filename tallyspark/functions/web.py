"""Storage paths, addresses and request parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def storage_path(project_id: Column, at: Column, name: Column) -> Column:
    return F.concat(
        project_id.cast("string"), F.lit("/"), F.unix_millis(at).cast("string"), F.lit("-"), name
    )


def encode_path(path: Column) -> Column:
    """Each segment percent-encoded, the slashes kept."""
    segments = F.transform(
        F.split(path, "/", -1),
        lambda s: _unreserved(F.url_encode(s)),
    )
    return F.array_join(segments, "/")


def _unreserved(encoded: Column) -> Column:
    # url_encode follows form rules; a path keeps these characters and spells a space %20
    for form, plain in (
        ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def object_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), encode_path(path))


def positive_parameter(url: Column, key: str, default: int = 1) -> Column:
    """Query parameter as a finite number above zero, else the default."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(key)).try_cast("double")
    good = raw.isNotNull() & ~F.isnan(raw) & (raw > 0) & (raw < F.lit(float("inf")))
    return F.when(good, raw).otherwise(F.lit(float(default)))


def path_id(path: Column, prefix: str) -> Column:
    """The id in `prefix/<digits>`, null when the path has another shape."""
    return F.nullif(
        F.regexp_extract(path, rf"^{prefix}/(\d+)$", 1), F.lit("")
    ).try_cast("long")


def version_label(at: Column) -> Column:
    return F.concat(F.lit("v"), F.unix_millis(at).cast("string"))
