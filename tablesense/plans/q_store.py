"""Result-store queries. The store lives in the shared
checkpoint folder; ``NOW`` is fixed so runs are reproducible. Fingerprints
use Spark's 64-bit row hash, which DuckDB has no twin of, so the oracles leave
the hash itself out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.operators import profile as P
from tablesense.operators import store as S
from tablesense.plans.catalog import TABLES, load, load_all
from tablesense.plans.registry import query
from tablesense.session import materialize, scratch_path
from tablesense.sources import files as FL
from tablesense.sources import readers as RD

NOW = 1_767_225_600  # 2026-01-01T00:00:00Z


@query("content_fingerprint", sql="""
SELECT doc_id, md5(text) AS content_md5, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents""")
def q_content_fingerprint(spark, sf_dir):
    return FL.content_fingerprint(load(spark, sf_dir, "documents"), "doc_id", "text")


def _store(spark, sf_dir):
    """A store holding table profiles of every table: even-numbered tables
    written 100 s before NOW (valid), odd ones 10,000 s before (expired)."""
    tables = load_all(spark, sf_dir)
    fps = materialize(S.fingerprints(tables))
    cp = P.catalog_column_profile(tables, "none")
    tp = P.table_profile(cp, None).select("table_name", "record_count", "field_count",
                                         "estimated_size_mb")
    path = scratch_path(spark, "profile-store")
    fresh = [t for i, t in enumerate(TABLES) if i % 2 == 0]
    rows = S.entries(tp, fps, "table_profile", NOW)
    rows = rows.withColumn("written_at", F.when(F.col("table_name").isin(*fresh), F.lit(NOW - 100))
                           .otherwise(F.lit(NOW - 10000)).cast("long"))
    S.write(rows, path)
    return fps, path


# The oracle: every table by number, even ones fresh. Hashes and the payload's
# size have no twin there and are left out.
STORED_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', CAST({NOW - 100 if i % 2 == 0 else NOW - 10000} AS BIGINT))" for i, t in enumerate(TABLES)) + ") v(table_name, written_at)) s"


@query("profile_store_write", sql=f"SELECT table_name, 'intended' AS mode, 'table_profile' AS analysis_type, written_at FROM {STORED_SQL}")
def q_profile_store_write(spark, sf_dir):
    _, path = _store(spark, sf_dir)
    return S.read_latest(spark, path).select("table_name", "mode", "analysis_type", "written_at")


@query("store_hits", sql=f"SELECT table_name, 'intended' AS mode FROM {STORED_SQL} WHERE {NOW} - written_at < 3600")
def q_store_hits(spark, sf_dir):
    fps, path = _store(spark, sf_dir)
    return S.hits(fps, S.read_latest(spark, path), NOW).select("table_name", "mode")


@query("store_misses", sql=f"SELECT table_name, 'intended' AS mode FROM {STORED_SQL} WHERE {NOW} - written_at >= 3600")
def q_store_misses(spark, sf_dir):
    fps, path = _store(spark, sf_dir)
    return S.misses(fps, S.read_latest(spark, path), NOW).select("table_name", "mode")


@query("store_expire", sql=f"SELECT table_name, written_at FROM {STORED_SQL} WHERE {NOW} - written_at < 3600")
def q_store_expire(spark, sf_dir):
    _, path = _store(spark, sf_dir)
    return S.expire(spark, path, scratch_path(spark, "profile-store-v2"), NOW).select(
        "table_name", "written_at")


@query("store_stats", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (WHERE {NOW} - written_at < 3600) AS BIGINT) AS valid,
  CAST(count(*) FILTER (WHERE {NOW} - written_at >= 3600) AS BIGINT) AS expired, true AS has_payload FROM {STORED_SQL}""")
def q_store_stats(spark, sf_dir):
    _, path = _store(spark, sf_dir)
    st = S.stats(spark.read.parquet(path), NOW)
    return st.select(F.col("entries").cast("long"), F.col("valid").cast("long"),
                     F.col("expired").cast("long"), (F.col("payload_mb") > 0).alias("has_payload"))


FACT_FORMATS = {"customer": "xml", "orders": "xml", "supplier": "xml", "lineitem": "csv", "events": "csv", "part": "json"}


XML_STRUCTURE = {"customer": "'cadastral'", "orders": "'generic'", "supplier": "'generic'"}


@query("parse_facts", sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{f}' AS format, CASE WHEN '{f}' = 'xml' AND count(*) >= 10000 THEN 'streaming' WHEN '{f}' = 'csv' AND count(*) >= 50000 "
    f"THEN 'chunked' ELSE 'full' END AS strategy, {XML_STRUCTURE.get(t, 'NULL')} AS xml_structure, true AS has_size FROM {t}"
    for t, f in FACT_FORMATS.items()))
def q_parse_facts(spark, sf_dir):
    """Tables written as files of several formats, customers as cadastral records."""
    base, tables, paths = scratch_path(spark, "facts"), {}, {}
    for t, fmt in FACT_FORMATS.items():
        df, paths[t] = load(spark, sf_dir, t), f"{base}/{t}"
        if t == "customer":
            df = df.select(F.struct(F.col("c_custkey").alias("cad_number")).alias("data"), "c_name")
        if fmt == "xml":
            df.write.format("xml").option("rowTag", "item").option("rootTag", "root").save(paths[t])
            tables[t] = RD.read_xml(spark, paths[t], "item")
        elif fmt == "csv":
            df.write.option("header", True).csv(paths[t])
            tables[t] = RD.read_csv(spark, paths[t])
        else:
            df.write.json(paths[t])
            tables[t] = RD.read_json(spark, paths[t])
    rows = reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for t, df in tables.items()])
    facts = S.parse_facts(spark, {t: f"{p}/part-*" for t, p in paths.items()}, P.column_names(tables).join(rows, "table_name"))
    return facts.select("table_name", "format", "strategy", "xml_structure", (F.col("file_mb") > 0).alias("has_size"))
