"""DuckDB SQL for the oracle side: the column and table profiles written
as plain SQL (one ``SELECT`` per column, ``UNION ALL``), plus the rule
table as ``VALUES``. Query oracles build on these as CTEs."""

from __future__ import annotations

from tablesense.functions import names as N
from tablesense.operators import rules as R
from tablesense.plans.catalog import SCHEMAS, TABLES

# Written out here, not taken from the implementation.
NUM_RE = r"^-?[0-9]*\.?[0-9]+$"
ISO_RE = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
DOT_RE = "^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4})( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
SLASH_RE = "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
TS_FMT = "%Y-%m-%dT%H:%M:%S.%f"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _column_select(table: str, ordinal: int, col: str, kind: str, width: int | None) -> str:
    c = q(col)
    if kind == "nested":
        byte_size = f"coalesce(sum(len({c})), 0) * {width}"
    elif width is not None:
        byte_size = f"count(*) * {width}"
    else:
        byte_size = f"coalesce(sum(strlen({c})), 0)"
    if kind == "string":
        mn, mx = f"min({c})", f"max({c})"
    elif kind == "int":
        mn, mx = f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)"
    elif kind == "timestamp":
        mn, mx = f"strftime(min({c}), '{TS_FMT}')", f"strftime(max({c}), '{TS_FMT}')"
    else:
        mn = mx = "CAST(NULL AS VARCHAR)"
    num = kind in ("int", "float")
    mnn = f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
    mxn = f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
    if kind == "string":
        off = "[+-][0-9]{2}:?[0-9]{2}$"  # of a time of day, taken off to give UTC
        away = (f"to_minutes(CAST(regexp_extract({c}, '([+-])[0-9]{{2}}:?[0-9]{{2}}$', 1) || '1' AS INTEGER) * "
                f"(60 * CAST(regexp_extract({c}, '[+-]([0-9]{{2}}):?[0-9]{{2}}$', 1) AS INTEGER) + CAST(regexp_extract({c}, '([0-9]{{2}})$', 1) AS INTEGER)))")
        parsed = (f"CASE WHEN regexp_matches({c}, '{ISO_RE}') THEN CASE WHEN regexp_matches({c}, 'T|:') AND regexp_matches({c}, '[0-9]{off}') "
                  f"THEN try_cast(regexp_replace({c}, '{off}', '') AS TIMESTAMP) - {away} ELSE try_cast(regexp_replace({c}, 'Z$', '') AS TIMESTAMP) END "
                  f"WHEN regexp_matches({c}, '{DOT_RE}') THEN try_cast(regexp_replace({c}, '{DOT_RE}', '\\3-\\2-\\1\\4') AS TIMESTAMP) "
                  f"WHEN regexp_matches({c}, '{SLASH_RE}') THEN try_cast(regexp_replace({c}, '{SLASH_RE}', '\\1-\\2-\\3\\4') AS TIMESTAMP) END")
        # All values in one form: each form is tried on the whole column.
        def tried(guard: str, *days: str) -> str:
            formats = ", ".join(f"'{d}{t}'" for d in days for t in ("", " %H:%M", " %H:%M:%S"))
            return f"CASE WHEN regexp_matches({c}, '{guard}') THEN try_strptime({c}, [{formats}]) END"
        old = lambda pattern: f"CASE WHEN regexp_matches({c}, '{pattern}') THEN {parsed} END"
        md, dm = tried("^[0-9]{1,2}/", "%m/%d/%Y"), tried("^[0-9]{1,2}/", "%d/%m/%Y")
        mdd, dmd = tried("^[0-9]{1,2}-", "%m-%d-%Y"), tried("^[0-9]{1,2}-", "%d-%m-%Y")
        named = tried("[A-Za-z]{3} ?", "%d %b %Y", "%d-%b-%Y", "%b %d, %Y", "%B %d, %Y", "%d %B %Y")
        month, day = f"coalesce({parsed}, {md}, {mdd}, {named})", f"coalesce({parsed}, {dm}, {dmd}, {named})"
        every = lambda x: f"count({x}) = count({c})"
        hit = f"coalesce(bool_or(regexp_matches({c}, '{NUM_RE}')), false)"
        forms = {"y-m-d": old(ISO_RE), "d.m.y": old(DOT_RE), "y/m/d": old(SLASH_RE), "m/d/y": md, "d/m/y": dm, "m-d-y": mdd, "d-m-y": dmd, "month name": named}
        ts_ok = f"(count({c}) > 0 AND ({' OR '.join(every(x) for x in forms.values())}))"
        turned = f"(NOT {every(md)} AND {every(dm)} OR NOT {every(mdd)} AND {every(dmd)})"
        tmin, tmax = (f"CASE WHEN {turned} THEN {f}({day}) ELSE {f}({month}) END" for f in ("min", "max"))
        names = "concat_ws(' or ', " + ", ".join(f"CASE WHEN {every(x)} THEN '{n}' END" for n, x in forms.items()) + ")"
    elif kind == "timestamp":
        hit, ts_ok = "false", f"(count({c}) > 0)"
        tmin, tmax = f"min({c})", f"max({c})"
    else:
        hit, ts_ok = "false", "false"
        tmin = tmax = "CAST(NULL AS TIMESTAMP)"
    if kind != "string":
        names = "CAST(NULL AS VARCHAR)"
    err = (f"max(abs(CAST(CAST({c} AS FLOAT) AS DOUBLE) - CAST({c} AS DOUBLE)))"
           if num else "CAST(NULL AS DOUBLE)")
    return (
        f"SELECT {lit(table)} AS table_name, {ordinal} AS ordinal, {lit(col)} AS column_name, {lit(kind)} AS kind, "
        f"CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, {mn} AS min_value, {mx} AS max_value, "
        f"{mnn} AS min_num, {mxn} AS max_num, CAST({byte_size} AS BIGINT) AS byte_size, "
        f"{hit} AS numeric_hit, {ts_ok} AS timestamp_ok, {tmin} AS ts_min, {tmax} AS ts_max, "
        f"{err} AS f32_err, {names} AS date_forms FROM {q(table)}"
    )


# Tables derived for queries, by name: (table whose schema they have, their SQL).
DERIVED = {
    "region_none": ("region", "SELECT * FROM region WHERE r_regionkey < 0"),
    "nation_nulled": ("nation", "SELECT nullif(n_nationkey, n_nationkey) AS n_nationkey, nullif(n_name, n_name) AS n_name, "
                                "nullif(n_regionkey, n_regionkey) AS n_regionkey FROM nation"),
    "region_repeated": ("region", "SELECT * FROM region UNION ALL SELECT * FROM region UNION ALL SELECT * FROM region"),
    "part_names": ("part_names", "SELECT p_name FROM part"),
    "customer_wide": ("customer_wide", "SELECT " + ", ".join(f"c_custkey + {i} AS k{i}" for i in range(101)) + " FROM customer"),
}
WIDE = [(f"k{i}", "int", 8) for i in range(101)]


def schema_of(table: str) -> list[tuple[str, str, int | None]]:
    base = DERIVED[table][0] if table in DERIVED else table
    return {"part_names": [("p_name", "string", None)], "customer_wide": WIDE}.get(base) or SCHEMAS[base]


def derived_ctes(tables: list[str]) -> list[str]:
    return [f"{t} AS ({DERIVED[t][1]})" for t in tables if t in DERIVED]


def column_profile_sql(tables: list[str] | None = None) -> str:
    parts = []
    for t in tables or TABLES:
        for i, (col, kind, width) in enumerate(schema_of(t)):
            parts.append(_column_select(t, i + 1, col, kind, width))
    return "\nUNION ALL\n".join(parts)


def narrowed_sql() -> str:
    """SELECT over cp0 adding base_dtype and narrowed (same CASE as Spark)."""
    return f"""
SELECT *,
  CASE
    WHEN base_dtype = 'int64' AND row_count > 0 THEN
      CASE WHEN min_num > 0 THEN
             CASE WHEN max_num < 255 THEN 'uint8' WHEN max_num < 65535 THEN 'uint16'
                  WHEN max_num < 4294967295 THEN 'uint32' ELSE 'int64' END
           WHEN min_num > -128 AND max_num < 127 THEN 'int8'
           WHEN min_num > -32768 AND max_num < 32767 THEN 'int16'
           WHEN min_num > -2147483648 AND max_num < 2147483647 THEN 'int32'
           ELSE 'int64' END
    WHEN base_dtype = 'float64' AND f32_err <= 0.0005 THEN 'float32'
    WHEN base_dtype = 'object' AND row_count > 0
         AND (distinct_count + CASE WHEN null_count > 0 THEN 1 ELSE 0 END) / row_count < 0.5 THEN 'category'
    ELSE base_dtype END AS narrowed
FROM (SELECT *,
        CASE WHEN kind = 'int' AND null_count = 0 THEN 'int64'
             WHEN kind IN ('int', 'float') THEN 'float64'
             WHEN kind = 'bool' AND null_count = 0 THEN 'bool'
             WHEN kind = 'timestamp' THEN 'datetime64[ns]'
             ELSE 'object' END AS base_dtype
      FROM cp0) b
"""


def tokens_sql(col: str) -> str:
    return (f"lower(regexp_replace(regexp_replace({col}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), "
            f"'[ .\\-]+', '_', 'g'))")


def words(ws: list[str]) -> str:
    return "(" + "|".join(ws) + ")"


def flags_sql(mode: str = "intended") -> str:
    """Per-column flags over cp."""
    ratio = "CASE WHEN row_count > 0 THEN distinct_count / row_count END"
    if mode == "observed":
        return f"""
SELECT *,
  coalesce(narrowed = 'object' AND (timestamp_ok OR distinct_count = 0), false) AS is_temporal,
  coalesce(narrowed IN ('int64', 'int32', 'int16', 'float64', 'float32')
           OR (narrowed = 'object' AND numeric_hit), false) AS is_numeric,
  narrowed = 'object' AS is_text,
  coalesce(narrowed = 'object' AND {ratio} < 0.5, false) AS is_categorical,
  regexp_matches(lower(column_name), '{words(N.SPATIAL_NAME_WORDS)}') AS is_spatial_name,
  coalesce(distinct_count = row_count AND row_count > 0
           AND (regexp_matches(lower(column_name), '{words(N.ID_NAME_WORDS)}')
                OR narrowed IN ('int64', 'int32')), false) AS is_unique_id,
  false AS is_nested,
  lower(column_name) AS lower_name,
  {ratio} AS ratio
FROM cp
"""
    return f"""
SELECT *,
  coalesce(timestamp_ok AND kind IN ('string', 'timestamp'), false) AS is_temporal,
  coalesce(kind IN ('int', 'float') OR (kind = 'string' AND numeric_hit), false) AS is_numeric,
  kind = 'string' AS is_text,
  coalesce(kind = 'string' AND {ratio} < 0.5, false) AS is_categorical,
  regexp_matches({tokens_sql('column_name')}, '{N.SPATIAL_TOKEN_PATTERN}') AS is_spatial_name,
  coalesce(distinct_count = row_count AND row_count > 0
           AND (regexp_matches(lower(column_name), '{words(N.ID_NAME_WORDS)}') OR kind = 'int'), false)
    AS is_unique_id,
  kind = 'nested' AS is_nested,
  lower(column_name) AS lower_name,
  {ratio} AS ratio
FROM cp
"""


def dups_sql(tables: list[str] | None = None) -> str:
    parts = [f"SELECT {lit(t)} AS table_name, CAST((SELECT count(*) FROM {q(t)}) - "
             f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {q(t)})) AS BIGINT) AS duplicate_rows"
             for t in tables or TABLES]
    return "\nUNION ALL\n".join(parts)


def table_profile_sql(mode: str = "intended") -> str:
    """tp over cf (flags) and dups."""
    weight = ("CASE WHEN kind = 'string' THEN 0.3 WHEN kind IN ('int', 'float') THEN 0.6 ELSE 0.8 END"
              if mode != "observed" else
              "CASE WHEN narrowed = 'object' THEN 0.3 WHEN narrowed IN ('int64', 'float64') THEN 0.6 "
              "ELSE 0.8 END")
    return """
SELECT a.*, coalesce(d.duplicate_rows, 0) AS duplicate_rows,
  CASE WHEN record_count * field_count > 0 THEN null_cells / (record_count * field_count) ELSE 0 END
    AS null_ratio,
  CASE WHEN record_count > 0 THEN coalesce(d.duplicate_rows, 0) / record_count ELSE 0 END AS dup_ratio,
  greatest(0.0, least(1.0, 1.0 - (
    CASE WHEN record_count * field_count > 0 THEN null_cells / (record_count * field_count) ELSE 0 END
    + CASE WHEN record_count > 0 THEN coalesce(d.duplicate_rows, 0) / record_count ELSE 0 END)))
    AS quality_score
FROM (
  SELECT table_name,
    max(row_count) AS record_count,
    CAST(count(*) AS INTEGER) AS field_count,
    bool_or(is_temporal) AS has_temporal,
    bool_or(is_numeric) AS has_numeric,
    bool_or(is_text) AS has_text,
    bool_or(is_categorical) AS has_categorical,
    bool_or(is_spatial_name) OR (bool_or(lower_name = 'x') AND bool_or(lower_name = 'y')) AS has_spatial,
    bool_or(is_nested) AS has_nested,
    coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE is_unique_id), '') AS unique_ids,
    arg_min(ts_min, ordinal) FILTER (WHERE is_temporal) AS ts_min,
    arg_min(ts_max, ordinal) FILTER (WHERE is_temporal) AS ts_max,
    sum(byte_size) / 1048576.0 AS estimated_size_mb,
    sum(null_count) AS null_cells,
    CASE WHEN sum(byte_size) > 0 THEN
      sum(byte_size * WEIGHT) / sum(byte_size)
      ELSE 1.0 END AS compression_ratio
  FROM cf GROUP BY table_name) a
LEFT JOIN dups d USING (table_name)
""".replace("WEIGHT", weight)


def profile_ctes(tables: list[str] | None = None, with_dups: bool = True,
                 mode: str = "intended") -> str:
    """WITH-list defining cp0, cp (with narrowed), cf (flags), dups, tp."""
    ctes = derived_ctes(tables or TABLES) + [f"cp0 AS (\n{column_profile_sql(tables)}\n)", f"cp AS ({narrowed_sql()})",
            f"cf AS ({flags_sql(mode)})"]
    if with_dups:
        ctes.append(f"dups AS (\n{dups_sql(tables)}\n)")
    else:
        ctes.append("dups AS (SELECT CAST(NULL AS VARCHAR) AS table_name, CAST(0 AS BIGINT) AS duplicate_rows)")
    ctes.append(f"tp AS ({table_profile_sql(mode)})")
    return "WITH " + ",\n".join(ctes)


def _v(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(lit(e) for e in x) + "]"
    return lit(str(x))


def rules_sql(mode: str = "intended") -> str:
    """The rule table as a VALUES list with the same columns as Spark's."""
    cols = ["ord", "name", "r_temporal", "r_text", "r_categorical", "r_spatial", "r_nested",
            "mb_gt", "mb_lt", "mb_ge", "mb_le", "rows_gt", "rows_lt", "rows_ge", "rows_le",
            "fields_gt", "fields_lt", "priority", "target", "confidence", "schedule_hint", "hints"]
    rows = []
    for r in R.RULES:
        r = list(r[:21])
        if mode == "observed" and r[1] == "medium_mixed_data":
            r[9] = r[10] = r[11] = r[12] = r[13] = r[14] = None
        vals = [_v(x) for x in r]
        vals[19] = f"CAST({r[19]} AS DECIMAL(4,2))"
        for k in (7, 8, 9, 10):
            if r[k] is not None:
                vals[k] = f"CAST({r[k]} AS DOUBLE)"
        vals.append(lit(" | ".join(R.RULES[r[0] - 1][22])))
        rows.append("(" + ", ".join(vals) + ")")
    return ("SELECT * FROM (VALUES " + ",\n".join(rows) + ") AS r(" + ", ".join(cols) + ")")


RULE_PREDICATE_SQL = """
  (r.r_temporal IS NULL OR p.has_temporal = r.r_temporal)
  AND (r.r_text IS NULL OR p.has_text = r.r_text)
  AND (r.r_categorical IS NULL OR p.has_categorical = r.r_categorical)
  AND (r.r_spatial IS NULL OR p.has_spatial = r.r_spatial)
  AND (r.r_nested IS NULL OR p.has_nested = r.r_nested)
  AND (r.mb_gt IS NULL OR p.estimated_size_mb > r.mb_gt)
  AND (r.mb_lt IS NULL OR p.estimated_size_mb < r.mb_lt)
  AND (r.mb_ge IS NULL OR p.estimated_size_mb >= r.mb_ge)
  AND (r.mb_le IS NULL OR p.estimated_size_mb <= r.mb_le)
  AND (r.rows_gt IS NULL OR p.record_count > r.rows_gt)
  AND (r.rows_lt IS NULL OR p.record_count < r.rows_lt)
  AND (r.rows_ge IS NULL OR p.record_count >= r.rows_ge)
  AND (r.rows_le IS NULL OR p.record_count <= r.rows_le)
  AND (r.fields_gt IS NULL OR p.field_count > r.fields_gt)
  AND (r.fields_lt IS NULL OR p.field_count < r.fields_lt)
"""
