"""Name-based predicates and name cleaning, as Column expressions.

Each function takes a Column holding column names and returns a Column,
so it can be applied to a whole ``column_profile`` at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Keyword lists that must equal the reference's, in its order.
# ---------------------------------------------------------------------------
TEMPORAL_NAME_WORDS = ["date", "time", "created", "updated", "timestamp"]
SPATIAL_NAME_WORDS = ["lat", "lon", "latitude", "longitude", "coordinate",
                      "coords", "geometry", "point", "polygon"]
ID_NAME_WORDS = ["id", "uuid", "guid", "key", "code", "number"]
CATEGORY_NAME_WORDS = ["type", "category", "status", "state", "gender", "country"]
JSON_NAME_WORDS = ["json", "dict"]
GEOMETRY_NAME_WORDS = ["lat", "lon", "coord"]
NUMERIC_ROLE_WORDS = ["id", "price", "amount", "count", "number", "quantity"]
TEXT_ROLE_WORDS = ["name", "description", "title", "status", "type"]
XML_SPATIAL_WORDS = ["coord", "lat", "lon", "x", "y", "geometry"]
CADASTRAL_NAME_WORDS = ["cad", "кадастр"]
# end of fixed values

# Whole-token spatial words for the intended mode (plural forms allowed).
SPATIAL_TOKEN_PATTERN = (
    "(^|_)(lat|lon|latitude|longitude|coordinates?|coords|geometry|points?|polygons?)(_|$)"
)


def any_word(words: list[str]) -> str:
    """Regex matching any of ``words`` as a substring (all are plain words)."""
    return "(" + "|".join(words) + ")"


def contains_any(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike(any_word(words))


def tokens(name: Column) -> Column:
    """Lower-case name with camelCase, '.', '-' and spaces turned into '_'."""
    split_camel = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(split_camel, "[ .\\-]+", "_"))


def has_token(name: Column, words: list[str]) -> Column:
    """Whether a whole token of the name is one of ``words``."""
    return tokens(name).rlike(f"(^|_){any_word(words)}(_|$)")


def is_temporal_name(name: Column) -> Column:
    return contains_any(name, TEMPORAL_NAME_WORDS)


def is_id_name(name: Column) -> Column:
    return contains_any(name, ID_NAME_WORDS)


def is_spatial_name(name: Column, mode: str = "intended") -> Column:
    if mode == "observed":
        return contains_any(name, SPATIAL_NAME_WORDS)
    return tokens(name).rlike(SPATIAL_TOKEN_PATTERN)


def is_category_name(name: Column) -> Column:
    return contains_any(name, CATEGORY_NAME_WORDS)


def is_json_name(name: Column) -> Column:
    return contains_any(name, JSON_NAME_WORDS)


def is_geometry_name(name: Column) -> Column:
    return contains_any(name, GEOMETRY_NAME_WORDS)


def clean_name(name: Column) -> Column:
    """Space, '-', '.' to '_'; drop empty parts between underscores; lower."""
    underscored = F.regexp_replace(name, "[ .\\-]", "_")
    collapsed = F.regexp_replace(underscored, "_+", "_")
    trimmed = F.regexp_replace(collapsed, "^_|_$", "")
    return F.lower(trimmed)
