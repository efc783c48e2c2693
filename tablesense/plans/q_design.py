"""Physical-design queries and their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.functions import names as N
from tablesense.operators import design as D
from tablesense.operators import profile as P
from tablesense.operators import rules as R
from tablesense.plans import sqlgen as G
from tablesense.plans.catalog import TABLES, load, load_all
from tablesense.plans.registry import query
from tablesense.session import materialize


def _cp_tp(spark, sf_dir):
    cp = materialize(P.catalog_column_profile(load_all(spark, sf_dir), "auto"))
    return cp, materialize(P.table_profile(cp, None))


def CLEAN(x: str) -> str:
    return (f"lower(regexp_replace(regexp_replace(regexp_replace({x}, '[ .\\-]', '_', 'g'), "
            f"'_+', '_', 'g'), '^_|_$', '', 'g'))")


def rx(col: str, ws: list[str]) -> str:
    return f"regexp_matches(lower({col}), '{G.words(ws)}')"


BASE = G.profile_ctes(TABLES, with_dups=False)

TM = f""",
tm AS (
 SELECT c.table_name, c.ordinal, c.column_name, {CLEAN('c.column_name')} AS clean_name,
   CASE WHEN t.has_nested AND {rx('c.column_name', N.JSON_NAME_WORDS)} THEN 'JSONB'
        WHEN t.has_spatial AND {rx('c.column_name', N.GEOMETRY_NAME_WORDS)} THEN 'GEOMETRY(POINT, 4326)'
        WHEN c.kind = 'int' THEN 'BIGINT' WHEN c.kind = 'float' THEN 'DOUBLE PRECISION'
        WHEN c.kind = 'timestamp' THEN 'TIMESTAMP' WHEN c.kind = 'bool' THEN 'BOOLEAN'
        WHEN c.kind = 'nested' THEN 'JSONB'
        WHEN t.has_categorical AND {rx('c.column_name', N.CATEGORY_NAME_WORDS)} THEN 'VARCHAR(255)'
        ELSE 'TEXT' END AS pg_type,
   CASE WHEN c.kind = 'int' THEN 'Int64' WHEN c.kind = 'float' THEN 'Float64'
        WHEN c.kind = 'timestamp' THEN 'DateTime' WHEN c.kind = 'bool' THEN 'UInt8'
        WHEN t.has_categorical AND c.kind = 'string' AND c.ratio < 0.1 THEN 'LowCardinality(String)'
        ELSE 'String' END AS ch_type,
   CASE WHEN c.kind = 'int' THEN 'BIGINT' WHEN c.kind = 'float' THEN 'DOUBLE'
        WHEN c.kind = 'timestamp' THEN 'TIMESTAMP' WHEN c.kind = 'bool' THEN 'BOOLEAN'
        ELSE 'STRING' END AS hive_type,
   c.null_count = 0 AS not_null
 FROM cf c JOIN tp t USING (table_name))"""

IC = f""",
ic AS (
 SELECT table_name, ordinal, column_name,
   CASE WHEN min(src) = 1 THEN 'temporal_name' ELSE 'cardinality' END AS reason
 FROM (SELECT c.table_name, c.ordinal, c.column_name, 1 AS src FROM cf c JOIN tp t USING (table_name)
       WHERE t.has_temporal AND regexp_matches(lower(c.column_name), 'date|time')
       UNION ALL
       SELECT table_name, ordinal, column_name, 2 FROM cf WHERE ratio BETWEEN 0.1 AND 0.9) u
 GROUP BY table_name, ordinal, column_name)"""

IP = IC + f""",
ip AS (
 SELECT i.table_name, i.ordinal, 1 AS seq,
   'CREATE INDEX idx_' || i.table_name || '_' || {CLEAN('i.column_name')} || ' ON ' || i.table_name
   || CASE WHEN t.has_spatial AND {rx('i.column_name', N.GEOMETRY_NAME_WORDS)} THEN ' USING GIST ('
           ELSE ' (' END || {CLEAN('i.column_name')} || ');' AS statement
 FROM ic i JOIN tp t USING (table_name)
 UNION ALL
 SELECT c.table_name, c.ordinal, 2,
   'CREATE INDEX idx_' || c.table_name || '_' || {CLEAN('c.column_name')} || '_gin ON ' || c.table_name
   || ' USING GIN (' || {CLEAN('c.column_name')} || ');'
 FROM cf c JOIN tp t USING (table_name)
 WHERE t.has_nested AND {rx('c.column_name', N.JSON_NAME_WORDS)})"""

PC = f""",
pc AS (
 SELECT c.table_name,
   CASE WHEN bool_or(t.has_temporal) THEN coalesce(
     arg_min(c.column_name, c.ordinal) FILTER (WHERE {rx('c.column_name', N.TEMPORAL_NAME_WORDS)}),
     arg_min(c.column_name, c.ordinal) FILTER (WHERE c.kind = 'timestamp')) END AS ch_partition_column,
   CASE WHEN bool_or(t.has_temporal) THEN
     arg_min(c.column_name, c.ordinal) FILTER (WHERE {rx('c.column_name', N.TEMPORAL_NAME_WORDS)})
     END AS hdfs_partition_column
 FROM cf c JOIN tp t USING (table_name) GROUP BY c.table_name)"""

SK = PC + f""",
uid AS (
 SELECT table_name, string_agg({CLEAN('column_name')}, ', ' ORDER BY ordinal) AS ids
 FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS rn
       FROM cf WHERE is_unique_id) x
 WHERE rn <= 3 GROUP BY table_name),
sk AS (
 SELECT p.table_name,
   CASE WHEN p.ch_partition_column IS NOT NULL
        THEN 'toYYYYMM(' || {CLEAN('p.ch_partition_column')} || ')' END AS partition_by,
   CASE WHEN p.ch_partition_column IS NOT NULL
        THEN '(' || {CLEAN('p.ch_partition_column')} || coalesce(', ' || u.ids, '') || ')' END AS order_by
 FROM pc p LEFT JOIN uid u USING (table_name))"""


@query("type_mapping", sql=BASE + TM + """
SELECT table_name, ordinal, column_name, clean_name, pg_type, ch_type, hive_type, not_null FROM tm""")
def q_type_mapping(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.type_mapping(cp, tp)


@query("index_candidates", sql=BASE + IC + """
SELECT table_name, ordinal, column_name, reason FROM ic""")
def q_index_candidates(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.index_candidates(cp, tp)


@query("index_plan", sql=BASE + IP + """
SELECT table_name, ordinal, seq, statement FROM ip""")
def q_index_plan(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.index_plan(cp, tp)


@query("low_cardinality", sql=BASE + """
SELECT table_name, ordinal, column_name, distinct_count, row_count FROM cf
WHERE kind = 'string' AND ratio < 0.1""")
def q_low_cardinality(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir))
    return D.low_cardinality(cp)


@query("partition_column", sql=BASE + PC + """
SELECT table_name, ch_partition_column, hdfs_partition_column FROM pc""")
def q_partition_column(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.partition_column(cp, tp)


@query("sort_key", sql=BASE + SK + """
SELECT table_name, partition_by, order_by FROM sk""")
def q_sort_key(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.sort_key(cp, tp)


@query("clean_names", sql=BASE + f"""
SELECT table_name, ordinal, column_name, {CLEAN('column_name')} AS clean_name FROM cp""")
def q_clean_names(spark, sf_dir):
    cp = P.column_names(load_all(spark, sf_dir))
    return cp.select("table_name", "ordinal", "column_name",
                     N.clean_name(F.col("column_name")).alias("clean_name"))


@query("column_roles", sql=BASE + f"""
SELECT table_name, ordinal, column_name,
  CASE WHEN {rx('column_name', N.TEMPORAL_NAME_WORDS)} THEN 'temporal'
       WHEN {rx('column_name', N.NUMERIC_ROLE_WORDS)} THEN 'numeric'
       WHEN {rx('column_name', N.TEXT_ROLE_WORDS)} THEN 'text' ELSE 'other' END AS role
FROM cp""")
def q_column_roles(spark, sf_dir):
    return D.column_roles(P.column_names(load_all(spark, sf_dir)))


LAYOUT_FACTORS = [1, 100000]


@query("layout_plan", sql=BASE + PC + f""",
pp AS (
  SELECT tp.* REPLACE (tp.record_count * s.scale AS record_count,
                       tp.estimated_size_mb * s.scale AS estimated_size_mb), s.scale
  FROM tp, (VALUES {', '.join(f'({f})' for f in LAYOUT_FACTORS)}) AS s(scale)),
x AS (
  SELECT p.*, c.hdfs_partition_column,
    CASE WHEN p.has_nested THEN 'parquet' WHEN p.has_temporal THEN 'orc' ELSE 'parquet' END AS fmt,
    CASE WHEN p.has_numeric AND NOT p.has_text THEN 'snappy' WHEN p.has_text THEN 'gzip'
         ELSE 'zstd' END AS codec0,
    p.has_temporal AND c.hdfs_partition_column IS NOT NULL AS temporal,
    p.estimated_size_mb > {D.HASH_PARTITION_MB} AS big
  FROM pp p JOIN pc c USING (table_name))
SELECT table_name, CAST(scale AS BIGINT) AS scale, fmt AS file_format,
  CASE WHEN fmt = 'orc' AND codec0 = 'gzip' THEN 'zlib' ELSE codec0 END AS codec,
  CASE WHEN temporal THEN 'date' WHEN NOT has_temporal AND big THEN 'hash' ELSE 'none' END
    AS partitioning,
  CASE WHEN temporal THEN hdfs_partition_column END AS partition_column,
  CASE WHEN temporal THEN '{D.PARTITION_SIZE_TEXT}' END AS partition_size,
  CASE WHEN NOT has_temporal AND big THEN CAST(greatest(10, ceil(estimated_size_mb / 256)) AS INTEGER) END AS hash_partitions,
  CASE WHEN NOT has_temporal AND big THEN '10-20 partitions' END AS hash_advice,
  '/data/' || table_name || CASE WHEN has_temporal THEN '/year={{YYYY}}/month={{MM}}/day={{DD}}/'
    ELSE '/data/' END AS path_layout
FROM x""")
def q_layout_plan(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.layout_plan(cp, R.projected_profile(tp, LAYOUT_FACTORS))


DDL_SQL = BASE + TM + IP + SK + f""",
pgc AS (SELECT table_name, string_agg('    ' || clean_name || ' ' || pg_type
          || CASE WHEN not_null THEN ' NOT NULL' ELSE '' END, ',\n' ORDER BY ordinal) AS cols
        FROM tm GROUP BY table_name),
chc AS (SELECT table_name, string_agg('    ' || clean_name || ' ' || ch_type, ',\n' ORDER BY ordinal)
          AS cols FROM tm GROUP BY table_name),
hvc AS (SELECT table_name, string_agg('    ' || clean_name || ' ' || hive_type, ',\n' ORDER BY ordinal)
          AS cols FROM tm GROUP BY table_name),
pk AS (SELECT table_name,
         CASE WHEN count(*) FILTER (WHERE is_unique_id) > 0
              THEN string_agg({CLEAN('column_name')}, ', ' ORDER BY ordinal) FILTER (WHERE is_unique_id)
              ELSE string_agg({CLEAN('column_name')}, ', ' ORDER BY ordinal)
                   FILTER (WHERE distinct_count = row_count AND row_count > 0) END AS pk
       FROM cf GROUP BY table_name),
idx AS (SELECT table_name, string_agg(statement, '\n' ORDER BY seq * 100000 + ordinal) AS idx
        FROM ip GROUP BY table_name),
roll AS (SELECT table_name, string_agg('sum(' || {CLEAN('column_name')} || ') AS '
           || {CLEAN('column_name')} || '_sum', ',\n    ' ORDER BY ordinal) AS sums
         FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS rn
               FROM cp WHERE kind IN ('int', 'float')) x
         WHERE rn <= 3 GROUP BY table_name)
SELECT c.table_name, 'postgresql' AS target,
  CASE WHEN t.has_spatial OR t.has_nested THEN '-- Extensions\n' || concat_ws('\n',
         CASE WHEN t.has_spatial THEN 'CREATE EXTENSION IF NOT EXISTS postgis;' END,
         CASE WHEN t.has_nested THEN 'CREATE EXTENSION IF NOT EXISTS pg_trgm;' END) || '\n\n'
       ELSE '' END
  || 'CREATE TABLE ' || c.table_name || ' (\n' || c.cols
  || CASE WHEN coalesce(k.pk, '') <> '' THEN ',\n    PRIMARY KEY (' || k.pk || ')' ELSE '' END
  || '\n);' || CASE WHEN i.idx IS NOT NULL THEN '\n\n-- Indexes\n' || i.idx ELSE '' END AS ddl
FROM pgc c JOIN tp t USING (table_name) LEFT JOIN pk k USING (table_name)
LEFT JOIN idx i USING (table_name)
UNION ALL
SELECT c.table_name, 'clickhouse',
  'CREATE TABLE ' || c.table_name || ' (\n' || c.cols || '\n) ENGINE = MergeTree()\n'
  || CASE WHEN s.partition_by IS NOT NULL THEN 'PARTITION BY ' || s.partition_by || '\nORDER BY '
          || s.order_by ELSE 'ORDER BY tuple()' END || ';'
  || CASE WHEN p.ch_partition_column IS NOT NULL AND r.sums IS NOT NULL THEN
       '\n\n-- Materialized views\nCREATE MATERIALIZED VIEW ' || c.table_name
       || '_daily_stats\nENGINE = SummingMergeTree()\nPARTITION BY toYYYYMM(date)\n'
       || 'ORDER BY (date)\nAS SELECT\n    toDate(' || {CLEAN('p.ch_partition_column')}
       || ') AS date,\n    ' || r.sums || '\nFROM ' || c.table_name || '\nGROUP BY toDate('
       || {CLEAN('p.ch_partition_column')} || ');' ELSE '' END
FROM chc c JOIN sk s USING (table_name) JOIN pc p USING (table_name) LEFT JOIN roll r USING (table_name)
UNION ALL
SELECT c.table_name, 'hdfs',
  'CREATE EXTERNAL TABLE ' || c.table_name || ' (\n' || c.cols || '\n)\n'
  || CASE WHEN p.hdfs_partition_column IS NOT NULL THEN 'PARTITIONED BY (dt STRING)\n' ELSE '' END
  || 'STORED AS PARQUET\nLOCATION ''/data/' || c.table_name || '/'';'
FROM hvc c JOIN pc p USING (table_name)
"""


@query("ddl_script", sql=DDL_SQL)
def q_ddl_script(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.ddl_script(cp, tp)


ROLLUP_TABLES = ["events", "lineitem"]


def _rollup_sql() -> str:
    # Same choice as design.rollup_source, written out for the two tables.
    plan = {"events": ("ts", ["event_id", "user_id", "value"]),
            "lineitem": ("l_shipdate", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                        "l_extendedprice", "l_discount", "l_tax"])}
    parts = []
    for t, (ts, cols) in plan.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, strftime(CAST({ts} AS DATE), '%Y-%m-%d') AS date, "
                         f"'{c}' AS column_name, sum(CAST({c} AS DECIMAL(38,10))) AS total "
                         f"FROM {t} GROUP BY 2")
    return "\nUNION ALL\n".join(parts)


@query("daily_rollup", sql=_rollup_sql())
def q_daily_rollup(spark, sf_dir):
    parts = [D.daily_rollup_tall(load(spark, sf_dir, t), t) for t in ROLLUP_TABLES]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("index_candidates_observed", sql=BASE + """
SELECT c.table_name, c.ordinal, c.column_name, 'temporal_name' AS reason
FROM cf c JOIN tp t USING (table_name)
WHERE t.has_temporal AND regexp_matches(lower(c.column_name), 'date|time')
UNION ALL
SELECT table_name, ordinal, column_name, 'cardinality' FROM cf WHERE ratio BETWEEN 0.1 AND 0.9""")
def q_index_candidates_observed(spark, sf_dir):
    cp, tp = _cp_tp(spark, sf_dir)
    return D.index_candidates(cp, tp, mode="observed")
