"""Data-quality checks (V1-V5) and the nested-JSON string probe.

Output shape: one row per (table_name, severity, check, detail). All checks
work on the tiny ``table_profile`` and ``column_profile``; the probe for nested
JSON is a flag of the profile pass, over all values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.functions import names as N
from tablesense.operators import design as D

# ---------------------------------------------------------------------------
# Thresholds and messages of the reference's validator.
# ---------------------------------------------------------------------------
NULL_PERCENT_LIMIT = 80
DUPLICATE_SHARE_LIMIT = 0.5
MAX_COLUMNS, MIN_COLUMNS = 100, 2
MSG_EMPTY = "DataFrame is empty"
MSG_NULLS = "High percentage of null values: %.1f%%"
MSG_DUPS = "High number of duplicate rows: %d"
MSG_MANY_COLS = "High number of columns: %d"
MSG_FEW_COLS = "Low number of columns: %d"
MSG_NUMERIC_LOW_CARD = "Column '%s' has low cardinality for numeric data"
MSG_NESTED = "Column '%s' may contain nested JSON structures"
MSG_SPATIAL = "Column '%s' may contain spatial data"
MSG_CADASTRAL = "Column '%s' may contain cadastral information"
# end of fixed values


def _check(cond: Column, severity: str, name: str, detail: Column) -> Column:
    return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("check"),
                                 detail.alias("detail")))


def quality_checks(tp: DataFrame) -> DataFrame:
    """V1-V4 on table_profile. An empty table gets only the error, as in
    the reference (the other checks would divide by zero)."""
    rows, cols = F.col("record_count"), F.col("field_count")
    cells = rows * cols
    pct = F.when(cells > 0, F.col("null_cells") * 100.0 / cells)
    empty = rows == 0
    checks = F.array(
        _check(empty, "error", "empty", F.lit(MSG_EMPTY)),
        _check(~empty & (pct > NULL_PERCENT_LIMIT), "warning", "nulls",
               F.format_string(MSG_NULLS, pct)),
        _check(~empty & (F.col("duplicate_rows") > rows * DUPLICATE_SHARE_LIMIT), "warning",
               "duplicates", F.format_string(MSG_DUPS, F.col("duplicate_rows"))),
        _check(~empty & (cols > MAX_COLUMNS), "warning", "many_columns",
               F.format_string(MSG_MANY_COLS, cols)),
        _check(~empty & (cols < MIN_COLUMNS), "warning", "few_columns",
               F.format_string(MSG_FEW_COLS, cols)),
    )
    return (tp.select("table_name", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("c"))
              .select("table_name", "c.severity", "c.check", "c.detail"))


def nested_string_probe(cp: DataFrame) -> DataFrame:
    """For every string column, whether any value holds '{' or '['. The
    profile pass has looked at all values."""
    return cp.where(F.col("kind") == "string").select(
        "table_name", "ordinal", "column_name", F.col("nested_hit").alias("nested_json"))


def format_checks(cp: DataFrame, formats: dict[str, str], mode: str = "intended") -> DataFrame:
    """V5: the warnings of a table's source format. CSV: numeric columns of low
    cardinality; JSON: strings that look like nested JSON; XML: spatial and
    cadastral names, by whole words of the name (observed mode: by substrings,
    as the reference does, Q14).

    ``formats`` maps table -> 'csv' | 'json' | 'xml'; other tables get none."""
    if not formats:
        return cp.select("table_name", "ordinal").where("false").select(
            "*", *[F.lit(None).cast("string").alias(c) for c in ("severity", "check", "detail")])
    fmt = F.element_at(F.create_map(*[F.lit(x) for kv in formats.items() for x in kv]), F.col("table_name"))
    name = F.col("column_name")

    def warn(rows: DataFrame, check: str, message: str) -> DataFrame:
        return rows.select("table_name", "ordinal", F.lit("warning").alias("severity"),
                           F.lit(check).alias("check"), F.format_string(message, name).alias("detail"))

    if mode == "observed":
        spatial, cadastral = (N.contains_any(name, w) for w in (N.XML_SPATIAL_WORDS, N.CADASTRAL_NAME_WORDS))
    else:
        spatial, cadastral = (N.has_token(name, w) for w in (N.XML_SPATIAL_WORDS, N.CADASTRAL_NAME_WORDS))
    xml = cp.where(fmt == "xml")
    return reduce(DataFrame.unionByName, [
        warn(D.numeric_low_card(cp.where(fmt == "csv")), "numeric_low_cardinality", MSG_NUMERIC_LOW_CARD),
        warn(cp.where((fmt == "json") & F.col("nested_hit")), "nested_json", MSG_NESTED),
        warn(xml.where(spatial), "spatial_name", MSG_SPATIAL),
        warn(xml.where(cadastral), "cadastral_name", MSG_CADASTRAL)])


def all_checks(tp: DataFrame, cp: DataFrame, formats: dict[str, str], mode: str = "intended") -> DataFrame:
    """V1-V5 together (the intended mode keeps both generic and format
    warnings; the reference lets the format ones replace the others, Q8)."""
    return quality_checks(tp).unionByName(format_checks(cp, formats, mode).drop("ordinal"))
