"""Names, labels, categories and display texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that put a free-form object type into a category; the
# first row with a word inside the type wins.
CATEGORY_WORDS = (
    ("partition", ("partition", "interior")),
    ("door", ("door",)),
    ("window", ("window",)),
    ("furniture", ("furniture", "chair", "table")),
    ("electrical", ("electric", "symbol", "point")),
    ("text", ("text", "label")),
    ("wall", ("wall", "exterior")),
)

# Attributes of each category (drawing class, height in metres).
CATEGORY_ATTRIBUTES = (
    ("wall", "obj-wall", 2.6),
    ("partition", "obj-partition", 2.5),
    ("door", "obj-door", 2.1),
    ("window", "obj-window", 1.2),
    ("furniture", "obj-furniture", 0.7),
    ("electrical", "obj-electrical", 0.2),
    ("text", "obj-text", 0.2),
    ("other", "obj-wall", 0.7),
)

# Material families by the first pattern found in a category.
FAMILY_PATTERNS = (
    ("tile", "tile|floor"),
    ("glass", "glass"),
    ("wall", "wall|paint"),
    ("carpet", "carpet"),
    ("light", "light|electric"),
)

# Project states and their display names.
STATUS_LABELS = {
    "draft": "Draft",
    "in_progress": "In progress",
    "priced": "Priced",
    "sent": "Sent",
    "archived": "Archived",
}


def object_category(object_type: Column) -> Column:
    name = F.lower(F.coalesce(object_type, F.lit("")))
    bucket = F.lit("other")
    for category, words in reversed(CATEGORY_WORDS):
        found = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])
        bucket = F.when(found, F.lit(category)).otherwise(bucket)
    return bucket


def material_family(category: Column) -> Column:
    family = F.lit("other")
    for name, pattern in reversed(FAMILY_PATTERNS):
        family = F.when(category.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(family)
    return family


def status_label(status: Column) -> Column:
    pairs = [F.lit(v) for pair in STATUS_LABELS.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), status)


def pad_id(n: Column, width: int = 3) -> Column:
    """Zero-padded id; longer ids stay whole."""
    s = F.coalesce(n.cast("string"), F.lit(""))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")


def display_datetime(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM, HH:mm")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def is_pdf(name: Column, content_type: Column) -> Column:
    return (F.coalesce(content_type, F.lit("")) == "application/pdf") | F.lower(
        name
    ).endswith(".pdf")


def content_type_or_default(content_type: Column, default: str = "application/pdf") -> Column:
    """Content type cut to 50 characters; empty or missing gives the default."""
    given = F.nullif(content_type, F.lit(""))
    return F.substring(F.coalesce(given, F.lit(default)), 1, 50)


def line_description(label: Column, object_type: Column, material: Column) -> Column:
    return F.concat(F.coalesce(label, object_type), F.lit(" — "), material)


def brand_and_name(brand: Column, name: Column) -> Column:
    return F.trim(F.concat(F.coalesce(brand, F.lit("")), F.lit(" "), name))


def room_area_sqft(label: Column) -> Column:
    """Area from a label such as 10'-6" x 12'-0"; null for any other text."""
    side = r"(\d+)'-(\d+)\""
    pattern = rf"^\s*{side}\s*[xX]\s*{side}\s*$"

    def feet(first: int) -> Column:
        whole = F.regexp_extract(label, pattern, first).try_cast("double")
        inches = F.regexp_extract(label, pattern, first + 1).try_cast("double")
        return whole + inches / F.lit(12.0)

    return F.when(label.rlike(pattern), feet(1) * feet(3))
