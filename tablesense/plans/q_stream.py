"""Streaming queries (T1, T2) run to completion with availableNow. Their input is
written as several files, out of time order, and comes in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense.operators import store as S
from tablesense.plans.catalog import load
from tablesense.plans.q_design import _rollup_sql
from tablesense.plans.registry import dec, query
from tablesense.session import scratch_path
from tablesense.streaming import jobs as J

FILES = 5


def _files(df, name: str, spark) -> tuple[str, int]:
    """Folder of about equal files that each hold rows of the whole table, and
    how many of them make one of ``FILES`` micro-batches. Their number follows
    that of the input's partitions, so a file stays as small as one of these."""
    path, each = scratch_path(spark, name), -(-df.rdd.getNumPartitions() // FILES)
    df.repartition(FILES * max(1, each)).write.parquet(path)
    return path, max(1, each)


def _stream(df, name: str, spark):
    path, each = _files(df, name, spark)
    return J.file_stream(spark, path, "*.parquet", df.schema, max_files=each)


@query("daily_rollup_stream", sql="SELECT * FROM (" + _rollup_sql() + ") r WHERE table_name = 'events'")
def q_daily_rollup_stream(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return J.daily_rollup_stream(spark, _stream(ev, "rollup-in", spark), "events", scratch_path(spark, "rollup-out"),
                                 scratch_path(spark, "rollup-ckpt"))


@query("profile_store_stream", sql="""
SELECT 'doc_id' AS column_name, count(*) AS row_count, count(*) - count(doc_id) AS null_count, CAST(8 * count(*) AS BIGINT) AS byte_size,
  CAST(min(doc_id) AS DECIMAL(38,6)) AS min_num, CAST(max(doc_id) AS DECIMAL(38,6)) AS max_num, true AS near FROM documents
UNION ALL SELECT 'text', count(*), count(*) - count(text), CAST(sum(strlen(text)) AS BIGINT), NULL, NULL, true FROM documents
UNION ALL SELECT 'lang', count(*), count(*) - count(lang), CAST(sum(strlen(lang)) AS BIGINT), NULL, NULL, true FROM documents
UNION ALL SELECT 'source', count(*), count(*) - count(source), CAST(sum(strlen(source)) AS BIGINT), NULL, NULL, true FROM documents
UNION ALL SELECT 'n_chars', count(*), count(*) - count(n_chars), CAST(8 * count(*) AS BIGINT), CAST(min(n_chars) AS DECIMAL(38,6)),
  CAST(max(n_chars) AS DECIMAL(38,6)), true FROM documents""")
def q_profile_store_stream(spark, sf_dir):
    """The profile merged from micro-batches; near: the merged distinct sketch
    is within 10 % of the exact count."""
    docs = load(spark, sf_dir, "documents")
    stream = _stream(docs, "profile-in", spark)
    out = J.profile_stream(spark, stream, "documents", scratch_path(spark, "profile-parts"), scratch_path(spark, "profile-ckpt"))
    exact = J.P.exact_distinct({"documents": docs})
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= F.greatest(F.lit(2), F.col("exact") * 0.1)
    return out.join(exact, ["table_name", "ordinal"]).select(
        "column_name", "row_count", "null_count", "byte_size", dec("min_num").alias("min_num"), dec("max_num").alias("max_num"), near.alias("near"))


@query("table_profile_stream", sql="""
WITH d AS (SELECT doc_id % 7 AS k, lang, source, CAST(n_chars // 1000 AS BIGINT) AS n_thousand FROM documents),
  g AS (SELECT k, lang, source, n_thousand, count(*) AS c FROM d GROUP BY ALL),
  m AS (SELECT count(*) AS record_count, count(*) - count(k) + count(*) - count(lang) + count(*) - count(source) + count(*) - count(n_thousand) AS null_cells FROM d),
  u AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM g)
SELECT 'documents' AS table_name, record_count, 4 AS field_count, null_cells, duplicate_rows,
  CAST(greatest(0, least(1, 1 - (null_cells / (4.0 * record_count) + duplicate_rows / CAST(record_count AS DOUBLE)))) AS DECIMAL(38,6)) AS quality_score,
  true AS stored FROM m, u""")
def q_table_profile_stream(spark, sf_dir):
    """Duplicates and quality score of documents' facts (identifiers by their
    remainder, lengths by the thousand, so that rows repeat), from files that
    come in two runs; stored: a batch job over all rows finds the streamed
    profile in the store by its own fingerprint."""
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id % 7 AS k", "lang", "source", "CAST(n_chars div 1000 AS BIGINT) AS n_thousand")
    path, base, now = scratch_path(spark, "facts-in"), scratch_path(spark, "facts-out"), 1_767_225_600
    split = docs.withColumn("part", F.pmod(F.xxhash64("lang", "n_thousand"), F.lit(FILES)))
    for late in (True, False):  # the second run's files hold the smaller parts
        split.where((F.col("part") >= 2) == late).drop("part").write.mode("append").parquet(path)
        stream = J.file_stream(spark, path, "*.parquet", docs.schema, max_files=1)
        out = J.table_profile_stream(spark, stream, "documents", f"{base}/parts", f"{base}/ckpt", None if late else f"{base}/store", now)
    found = S.hits(S.fingerprints({"documents": docs}), S.read_latest(spark, f"{base}/store"), now + 60)
    return out.join(found.select("table_name", F.lit(True).alias("hit")), "table_name", "left").select(
        "table_name", "record_count", "field_count", "null_cells", "duplicate_rows", dec("quality_score").alias("quality_score"),
        F.coalesce("hit", F.lit(False)).alias("stored"))
