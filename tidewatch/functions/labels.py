"""Display labels and vendor resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import SPACE_CHARS

# Rubric label per impact score.
IMPACT_LABELS = {5: "Act now", 4: "High", 3: "Medium", 2: "Low", 1: "Noise"}


def string_array(c: Column) -> Column:
    """Parse a JSON array of strings; bad JSON or another shape gives an empty array and
    non-string members are dropped."""
    members = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    texts = F.filter(members, lambda m: F.schema_of_variant(m) == "STRING")
    values = F.transform(texts, lambda m: F.try_variant_get(m, "$", "string"))
    return F.coalesce(values, F.array().cast("array<string>"))


def resolve_vendor(vendors: Column, source_vendor: Column) -> Column:
    """The first enriched vendor, else the vendor of the source."""
    return F.coalesce(F.try_element_at(vendors, F.lit(1)), source_vendor)


def resolve_head_vendor(raw: Column, source_vendor: Column) -> Column:
    """The other rule in use: the first element of the JSON list counts only if it is a string."""
    head = F.try_variant_get(F.try_parse_json(raw), "$[0]", "variant")
    name = F.when(F.schema_of_variant(head) == "STRING", F.try_variant_get(F.try_parse_json(raw), "$[0]", "string"))
    return F.coalesce(name, source_vendor)


def impact_label(c: Column) -> Column:
    out = F.lit("Unscored")
    for score, label in IMPACT_LABELS.items():
        out = F.when(c == score, label).otherwise(out)
    return out


def relative_age(at: Column, now: Column) -> Column:
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000))
    return (
        F.when(at.isNull(), F.lit(""))
        .when(days <= 0, F.lit("today"))
        .when(days == 1, F.lit("yesterday"))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit("w ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )


def date_label(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("Undated"))


def initials(vendor: Column) -> Column:
    parts = F.filter(F.split(vendor, f"[{SPACE_CHARS}-]+"), lambda p: p != "")
    pair = F.concat(F.substring(F.get(parts, 0), 1, 1), F.substring(F.get(parts, 1), 1, 1))
    return (
        F.when(F.coalesce(vendor, F.lit("")) == "", F.lit("—"))
        .when(F.size(parts) >= 2, F.upper(pair))
        .otherwise(F.upper(F.substring(vendor, 1, 2)))
    )


def dimension_of(category: Column, source_kind: Column) -> Column:
    """Which part of a vendor's position a signal moves."""
    return (
        F.when(source_kind == "github", "release")
        .when(category == "Security", "security")
        .when(category == "Product", "capability")
        .when(category == "Pricing", "pricing")
        .when(category.isin("Business", "Ecosystem"), "positioning")
    )


def source_tier(kind: Column, source_vendor: Column, signal_vendor: Column) -> Column:
    same = F.lower(source_vendor) == F.lower(signal_vendor)
    own_feed = (kind == "rss") & (source_vendor != "") & (signal_vendor != "") & same
    primary = kind.isin("github", "nvd") | F.coalesce(own_feed, F.lit(False))
    return F.when(primary, F.lit("primary")).otherwise(F.lit("secondary"))


def recency_weight(at: Column, now: Column, half_life_days: float, undated_days: float) -> Column:
    age = F.greatest(
        F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0)
    )
    days = F.when(at.isNull(), F.lit(undated_days)).otherwise(age)
    return F.pow(F.lit(0.5), days / F.lit(half_life_days))
