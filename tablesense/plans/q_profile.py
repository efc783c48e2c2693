"""Profile queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.operators import profile as P
from tablesense.operators import sampling as S
from tablesense.plans import sqlgen as G
from tablesense.plans.catalog import TABLES, load, load_all
from tablesense.plans.registry import dec, iso, joined, query, sql_dec, sql_iso

ALL = TABLES


def catalog_profiles(spark: SparkSession, sf_dir: str, names: list[str] | None = None,
                     mode: str = "intended"):
    tables = load_all(spark, sf_dir, names)
    return P.profile_catalog(tables, mode=mode, distinct="auto")


# --------------------------------------------------------------------------
# column_profile
# --------------------------------------------------------------------------

def cp_report(cp: DataFrame) -> DataFrame:
    cp = P.with_narrowed(cp)
    return cp.select("table_name", "ordinal", "column_name", "kind", "row_count", "null_count",
                     "distinct_count", "min_value", "max_value", dec("min_num").alias("min_num"),
                     dec("max_num").alias("max_num"), "byte_size", "numeric_hit", "timestamp_ok",
                     iso("ts_min").alias("ts_min"), iso("ts_max").alias("ts_max"), "narrowed")


CP_REPORT_SQL = f"""
SELECT table_name, ordinal, column_name, kind, row_count, null_count, distinct_count, min_value,
  max_value, {sql_dec('min_num')} AS min_num, {sql_dec('max_num')} AS max_num, byte_size,
  numeric_hit, timestamp_ok, {sql_iso('ts_min')} AS ts_min, {sql_iso('ts_max')} AS ts_max, narrowed
FROM cp"""


@query("column_profile", sql=G.profile_ctes(ALL, with_dups=False) + CP_REPORT_SQL)
def q_column_profile(spark, sf_dir):
    return cp_report(P.catalog_column_profile(load_all(spark, sf_dir)))


# --------------------------------------------------------------------------
# table_profile
# --------------------------------------------------------------------------

def tp_report(tp: DataFrame) -> DataFrame:
    return tp.select("table_name", "record_count", "field_count", "has_temporal", "has_numeric",
                     "has_text", "has_categorical", "has_spatial", "has_nested",
                     joined("unique_ids").alias("unique_ids"), iso("ts_min").alias("ts_min"),
                     iso("ts_max").alias("ts_max"), dec("estimated_size_mb").alias("estimated_size_mb"),
                     "duplicate_rows", dec("quality_score").alias("quality_score"),
                     dec("compression_ratio").alias("compression_ratio"))


TP_REPORT_SQL = f"""
SELECT table_name, record_count, field_count, has_temporal, has_numeric, has_text, has_categorical,
  has_spatial, has_nested, unique_ids, {sql_iso('ts_min')} AS ts_min, {sql_iso('ts_max')} AS ts_max,
  {sql_dec('estimated_size_mb')} AS estimated_size_mb, duplicate_rows,
  {sql_dec('quality_score')} AS quality_score, {sql_dec('compression_ratio')} AS compression_ratio
FROM tp"""


@query("table_profile", sql=G.profile_ctes(ALL) + TP_REPORT_SQL)
def q_table_profile(spark, sf_dir):
    _, tp = catalog_profiles(spark, sf_dir)
    return tp_report(tp)


# --------------------------------------------------------------------------
# null_counts: nulls made with nullif on both sides (the tables have none)
# --------------------------------------------------------------------------

def _nulled(spark, sf_dir) -> dict[str, DataFrame]:
    ev = load(spark, sf_dir, "events").withColumn(
        "event_type", F.nullif(F.col("event_type"), F.lit("error")))
    od = load(spark, sf_dir, "orders").withColumn(
        "o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("F")))
    return {"events": ev, "orders": od}


def _null_counts_sql() -> str:
    parts = []
    for t, sel in [("events", "* REPLACE (nullif(event_type, 'error') AS event_type)"),
                   ("orders", "* REPLACE (nullif(o_orderstatus, 'F') AS o_orderstatus)")]:
        from tablesense.plans.catalog import SCHEMAS
        for i, (c, _, _) in enumerate(SCHEMAS[t]):
            parts.append(f"SELECT '{t}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, "
                         f"CAST(count(*) - count({G.q(c)}) AS BIGINT) AS null_count "
                         f"FROM (SELECT {sel} FROM {t})")
    return "\nUNION ALL\n".join(parts)


@query("null_counts", sql=_null_counts_sql())
def q_null_counts(spark, sf_dir):
    cp = P.catalog_column_profile(_nulled(spark, sf_dir), distinct="none")
    return cp.select("table_name", "ordinal", "column_name", "null_count")


# --------------------------------------------------------------------------
# unique counts: exact, sampled (md5 bottom-k), approximate
# --------------------------------------------------------------------------

UNIQUE_TABLES = TABLES


def _unique_sql(source: dict[str, str]) -> str:
    from tablesense.plans.catalog import SCHEMAS
    parts = []
    for t in source:
        for i, (c, _, _) in enumerate(SCHEMAS[t]):
            parts.append(f"SELECT '{t}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, "
                         f"CAST(count(DISTINCT {G.q(c)}) AS BIGINT) AS distinct_count "
                         f"FROM {source[t]}")
    return "\nUNION ALL\n".join(parts)


@query("unique_counts", sql=_unique_sql({t: t for t in UNIQUE_TABLES}))
def q_unique_counts(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir, UNIQUE_TABLES))
    return cp.select("table_name", "ordinal", "column_name", "distinct_count")


SAMPLE_N = 10000
SAMPLE_SEED = 42
SAMPLE_KEYS = {"part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def _sample_sql(t: str) -> str:
    key = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in SAMPLE_KEYS[t])
    return (f"(SELECT * FROM {t} ORDER BY md5('{SAMPLE_SEED}:' || {key}), "
            f"{', '.join(SAMPLE_KEYS[t])} LIMIT {SAMPLE_N})")


@query("unique_counts_sampled", sql=_unique_sql({t: _sample_sql(t) for t in SAMPLE_KEYS}))
def q_unique_counts_sampled(spark, sf_dir):
    tables = {t: S.sample_n(load(spark, sf_dir, t), SAMPLE_KEYS[t], SAMPLE_N, SAMPLE_SEED)
              for t in SAMPLE_KEYS}
    cp = P.catalog_column_profile(tables)
    return cp.select("table_name", "ordinal", "column_name", "distinct_count")


APPROX_BOUND = 0.1


@query("approx_unique_counts", sql="SELECT *, true AS within_bound FROM (" + _unique_sql({t: t for t in UNIQUE_TABLES}) + ")")
def q_approx_unique_counts(spark, sf_dir):
    """Sketched counts beside exact ones, and whether they agree to 10 %."""
    tables = load_all(spark, sf_dir, UNIQUE_TABLES)
    cp = P.catalog_column_profile(tables, distinct="approx").join(P.exact_distinct(tables), ["table_name", "ordinal"], "left")
    exact = F.coalesce("exact", F.lit(0).cast("long"))
    near = F.abs(F.col("distinct_count") - exact) <= F.greatest(F.lit(2), exact * APPROX_BOUND)
    return cp.select("table_name", "ordinal", "column_name", exact.alias("distinct_count"), near.alias("within_bound"))


# --------------------------------------------------------------------------
# size, compression, duplicates, quality
# --------------------------------------------------------------------------

SIZE_TABLES = TABLES


@query("size_estimate", sql=G.profile_ctes(SIZE_TABLES, with_dups=False) + """
SELECT table_name, ordinal, column_name, byte_size,
  CAST(sum(byte_size) OVER (PARTITION BY table_name) / 1048576.0 AS DECIMAL(38,6)) AS table_mb
FROM cp""")
def q_size_estimate(spark, sf_dir):
    from pyspark.sql import Window
    cp = P.catalog_column_profile(load_all(spark, sf_dir, SIZE_TABLES), "none")
    w = Window.partitionBy("table_name")
    return cp.select("table_name", "ordinal", "column_name", "byte_size",
                     dec(F.sum("byte_size").over(w) / F.lit(P.MB)).alias("table_mb"))


@query("compression_ratio", sql=G.profile_ctes(ALL, with_dups=False) + f"""
SELECT table_name, {sql_dec('compression_ratio')} AS compression_ratio FROM tp""")
def q_compression_ratio(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir), "none")
    tp = P.table_profile(cp, None)
    return tp.select("table_name", dec("compression_ratio").alias("compression_ratio"))


def _projections(spark, sf_dir) -> dict[str, DataFrame]:
    return {
        "lineitem_flags": load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus",
                                                                 "l_quantity"),
        "documents_meta": load(spark, sf_dir, "documents").select("text", "lang", "source"),
        "lineitem": load(spark, sf_dir, "lineitem"),
        "documents": load(spark, sf_dir, "documents"),
        "customer": load(spark, sf_dir, "customer"),
        "part": load(spark, sf_dir, "part"),
    }


_PROJ_SQL = {
    "lineitem_flags": "(SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)",
    "documents_meta": "(SELECT text, lang, source FROM documents)",
    "lineitem": "lineitem", "documents": "documents", "customer": "customer", "part": "part",
}


def _dup_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{k}' AS table_name, CAST((SELECT count(*) FROM {v}) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {v})) AS BIGINT) AS duplicate_rows, "
        f"CAST((SELECT count(*) FROM {v}) AS BIGINT) AS record_count"
        for k, v in _PROJ_SQL.items())


@query("duplicate_rows", sql=_dup_sql())
def q_duplicate_rows(spark, sf_dir):
    tables = _projections(spark, sf_dir)
    d = P.catalog_duplicate_rows(tables)
    from functools import reduce
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).cast("long").alias("record_count"))
        for t, df in tables.items()])
    return d.join(counts, "table_name")


@query("quality_score", sql=f"""
WITH d AS ({_dup_sql()})
SELECT table_name, duplicate_rows,
  {sql_dec("greatest(0.0, least(1.0, 1.0 - (CASE WHEN record_count > 0 THEN duplicate_rows / record_count ELSE 0 END)))")}
    AS quality_score
FROM d""")
def q_quality_score(spark, sf_dir):
    tables = _projections(spark, sf_dir)
    cp = P.catalog_column_profile(tables, distinct="none")
    tp = P.table_profile(cp, P.catalog_duplicate_rows(tables))
    return tp.select("table_name", "duplicate_rows", dec("quality_score").alias("quality_score"))


# --------------------------------------------------------------------------
# flags, narrowed types, temporal columns and range, ids and keys
# --------------------------------------------------------------------------

@query("profile_flags", sql=G.profile_ctes(ALL, with_dups=False) + """
SELECT table_name, has_temporal, has_numeric, has_text, has_categorical, has_spatial, has_nested
FROM tp""")
def q_profile_flags(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir), "auto")
    return P.table_profile(cp, None).select("table_name", "has_temporal", "has_numeric", "has_text",
                                            "has_categorical", "has_spatial", "has_nested")


@query("narrowed_type", sql=G.profile_ctes(ALL, with_dups=False) + """
SELECT table_name, ordinal, column_name, base_dtype, narrowed FROM cp""")
def q_narrowed_type(spark, sf_dir):
    cp = P.with_narrowed(P.catalog_column_profile(load_all(spark, sf_dir), "auto"))
    return cp.select("table_name", "ordinal", "column_name", "base_dtype", "narrowed")


def _temporal_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    od = load(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    dated = load(spark, sf_dir, "orders")
    form = lambda f: dated.select(F.date_format("o_orderdate", f).alias("o_orderdate"))
    mixed = dated.select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+03:00'"))
                         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("o_orderdate"))
    return {"orders_text_dates": od, "events": load(spark, sf_dir, "events"), "orders_dotted": form("dd.MM.yyyy"),
            "orders_slashed": form("yyyy/MM/dd HH:mm"), "orders_offsets": mixed,
            "orders_two_forms": form("dd.MM.yyyy").unionAll(form("yyyy-MM-dd")), "orders_month_first": form("MM/dd/yyyy"),
            "orders_day_first": form("dd/MM/yyyy HH:mm"), "orders_dashed": form("dd-MM-yyyy"), "orders_named": form("MMMM d, yyyy").unionAll(form("dd MMM yyyy")),
            "orders_either": dated.where(F.dayofmonth("o_orderdate") <= 12).select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate")),
            "orders_neither": form("MM/dd/yyyy").unionAll(form("dd/MM/yyyy"))}


_TEMPORAL_SQL_SRC = {
    "orders_text_dates": "(SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders)",
    "events": "events",
    "orders_dotted": "(SELECT strftime(o_orderdate, '%d.%m.%Y') AS o_orderdate FROM orders)",
    "orders_slashed": "(SELECT strftime(o_orderdate, '%Y/%m/%d %H:%M') AS o_orderdate FROM orders)",
    "orders_offsets": "(SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '+03:00' "
                      "ELSE 'Z' END AS o_orderdate FROM orders)",
    "orders_two_forms": "(SELECT strftime(o_orderdate, '%d.%m.%Y') AS o_orderdate FROM orders "
                        "UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders)",
    "orders_month_first": "(SELECT strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate FROM orders)",
    "orders_day_first": "(SELECT strftime(o_orderdate, '%d/%m/%Y %H:%M') AS o_orderdate FROM orders)",
    "orders_dashed": "(SELECT strftime(o_orderdate, '%d-%m-%Y') AS o_orderdate FROM orders)",
    "orders_named": "(SELECT strftime(o_orderdate, '%B %-d, %Y') AS o_orderdate FROM orders UNION ALL SELECT strftime(o_orderdate, '%d %b %Y') FROM orders)",
    "orders_either": "(SELECT strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate FROM orders WHERE day(o_orderdate) <= 12)",
    "orders_neither": "(SELECT strftime(o_orderdate, '%m/%d/%Y') AS o_orderdate FROM orders UNION ALL SELECT strftime(o_orderdate, '%d/%m/%Y') FROM orders)",
}


def _temporal_cp_sql() -> str:
    from tablesense.plans.catalog import SCHEMAS
    parts = []
    for alias, src in _TEMPORAL_SQL_SRC.items():
        base = "orders" if alias.startswith("orders") else alias
        cols = SCHEMAS[base] if alias in ("orders_text_dates", "events") else [("o_orderdate", "string", None)]
        for i, (c, kind, width) in enumerate(cols):
            k = "string" if c == "o_orderdate" else kind
            w = None if c == "o_orderdate" else width
            sel = G._column_select(alias, i + 1, c, k, w)
            parts.append(sel.replace(f"FROM {G.q(alias)}", f"FROM {src}"))
    return "\nUNION ALL\n".join(parts)


TEMPORAL_CTES = ("WITH cp0 AS (\n" + _temporal_cp_sql() + "\n), cp AS (" + G.narrowed_sql()
                 + "), cf AS (" + G.flags_sql() + ")")


@query("temporal_columns", sql=TEMPORAL_CTES + f"""
SELECT table_name, ordinal, column_name, is_temporal, CASE WHEN is_temporal THEN date_forms END AS date_form, {sql_iso('ts_min')} AS ts_min,
  {sql_iso('ts_max')} AS ts_max FROM cf""")
def q_temporal_columns(spark, sf_dir):
    cf = P.column_flags(P.catalog_column_profile(_temporal_inputs(spark, sf_dir), "none"))
    return cf.select("table_name", "ordinal", "column_name", "is_temporal", "date_form",
                     iso("ts_min").alias("ts_min"), iso("ts_max").alias("ts_max"))


@query("temporal_range", sql=TEMPORAL_CTES + f"""
SELECT table_name,
  arg_min(column_name, ordinal) FILTER (WHERE is_temporal) AS range_column,
  {sql_iso("arg_min(ts_min, ordinal) FILTER (WHERE is_temporal)")} AS ts_min,
  {sql_iso("arg_min(ts_max, ordinal) FILTER (WHERE is_temporal)")} AS ts_max
FROM cf GROUP BY table_name""")
def q_temporal_range(spark, sf_dir):
    cf = P.column_flags(P.catalog_column_profile(_temporal_inputs(spark, sf_dir), "none"))
    first = F.when(F.col("is_range_candidate"), F.col("ordinal"))
    return cf.groupBy("table_name").agg(
        F.min_by("column_name", first).alias("range_column"),
        iso(F.min_by("ts_min", first)).alias("ts_min"),
        iso(F.min_by("ts_max", first)).alias("ts_max"))


@query("unique_ids", sql=G.profile_ctes(ALL, with_dups=False) + """
SELECT table_name, unique_ids FROM tp""")
def q_unique_ids(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir), "auto")
    return P.table_profile(cp, None).select("table_name", joined("unique_ids").alias("unique_ids"))


@query("primary_keys", sql=G.profile_ctes(ALL, with_dups=False) + """
SELECT table_name,
  CASE WHEN count(*) FILTER (WHERE is_unique_id) > 0
       THEN string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE is_unique_id)
       ELSE coalesce(string_agg(column_name, ',' ORDER BY ordinal)
                     FILTER (WHERE distinct_count = row_count AND row_count > 0), '') END
    AS primary_keys
FROM cf GROUP BY table_name""")
def q_primary_keys(spark, sf_dir):
    from tablesense.operators import design as D
    cp = P.catalog_column_profile(load_all(spark, sf_dir), "auto")
    return D.primary_keys(cp).select("table_name", joined("primary_keys").alias("primary_keys"))


# --------------------------------------------------------------------------
# sampling and head
# --------------------------------------------------------------------------

SAMPLE_ROWS = 100


@query("sample_n", sql=f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
ORDER BY md5('{SAMPLE_SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT {SAMPLE_ROWS}""")
def q_sample_n(spark, sf_dir):
    od = load(spark, sf_dir, "orders")
    return S.sample_n(od, ["o_orderkey"], SAMPLE_ROWS, SAMPLE_SEED).select(
        "o_orderkey", "o_custkey", "o_orderstatus")


HEAD_ROWS = 1000


@query("bounded_head", sql=f"""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT {HEAD_ROWS}""")
def q_bounded_head(spark, sf_dir):
    od = load(spark, sf_dir, "orders")
    return S.bounded_head(od, ["o_orderkey"], HEAD_ROWS).select("o_orderkey", "o_custkey",
                                                                "o_orderstatus")


@query("profile_flags_observed", sql=G.profile_ctes(ALL, with_dups=False, mode="observed") + """
SELECT table_name, has_temporal, has_numeric, has_text, has_categorical, has_spatial, has_nested,
  unique_ids, CAST(compression_ratio AS DECIMAL(38,6)) AS compression_ratio
FROM tp""")
def q_profile_flags_observed(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir), "auto")
    tp = P.table_profile(cp, None, mode="observed")
    return tp.select("table_name", "has_temporal", "has_numeric", "has_text", "has_categorical",
                     "has_spatial", "has_nested", joined("unique_ids").alias("unique_ids"),
                     dec("compression_ratio").alias("compression_ratio"))
