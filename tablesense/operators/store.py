"""Profile store (K1, C1-C4, J3, A27): a Parquet table of results keyed by
table, mode and content fingerprint, with a write time for the TTL.

Parquet has no upsert: writers append and readers keep the latest row per
key (``row_number`` over the few versions of one key). Expiry writes the
rows still valid to a new version folder (Spark cannot overwrite a path it
is reading).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.operators import profile as P

# ---------------------------------------------------------------------------
# Time-to-live defaults of the reference's result cache.
# ---------------------------------------------------------------------------
DEFAULT_TTL_SEC = 3600
# end of fixed values

KEY = ["table_name", "mode", "content_hash", "analysis_type"]


def fingerprints(tables: dict[str, DataFrame], mode: str = "intended") -> DataFrame:
    """C1 at table scale: (table_name, mode, content_hash). The hash covers
    the row count and the sum of 64-bit row hashes (order-independent), one
    aggregation per table with partial sums, unioned into one plan."""
    parts = []
    for t, df in tables.items():
        h = P.row_hash(df).cast("decimal(38,0)")
        parts.append(df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("_n"),
                            F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("_s")))
    u = reduce(DataFrame.unionByName, parts)
    return u.select("table_name", F.lit(mode).alias("mode"), _content_hash(mode))


def _content_hash(mode: str) -> Column:
    """Of table_name, row count ``_n`` and sum of row hashes ``_s``."""
    return F.md5(F.concat_ws(":", "table_name", F.lit(mode), F.col("_n").cast("string"), F.col("_s").cast("string"))).alias("content_hash")


def counted_fingerprint(counts: DataFrame, table: str, mode: str = "intended") -> DataFrame:
    """The fingerprint of a table from its row hashes (h) and how often each
    occurs (count): the same as ``fingerprints`` of the rows."""
    one = F.col("h").cast("decimal(19,0)") * F.col("count").cast("decimal(18,0)")
    u = counts.agg(F.lit(table).alias("table_name"), F.coalesce(F.sum("count"), F.lit(0)).alias("_n"),
                   F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("_s"))
    return u.select("table_name", F.lit(mode).alias("mode"), _content_hash(mode))


def entries(results: DataFrame, fps: DataFrame, analysis_type: str, now: int) -> DataFrame:
    """K1: store rows for per-table results (any columns, kept as JSON)."""
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in results.columns]))
    r = results.select("table_name", payload.alias("payload"))
    return r.join(fps, "table_name").select(
        "table_name", "mode", "content_hash", F.lit(analysis_type).alias("analysis_type"),
        F.lit(now).cast("long").alias("written_at"), "payload")


def write(store_rows: DataFrame, path: str) -> None:
    """K1: append, partitioned by analysis type."""
    store_rows.write.mode("append").partitionBy("analysis_type").parquet(path)


def read_latest(spark, path: str) -> DataFrame:
    """The latest row per (table, mode, content, analysis type): content that
    returns within its time to live is found again."""
    s = spark.read.parquet(path)
    w = Window.partitionBy(*KEY).orderBy(F.col("written_at").desc(), F.col("payload"))
    return s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def valid(store: DataFrame, now: int, ttl: int = DEFAULT_TTL_SEC) -> DataFrame:
    """Rows younger than the TTL at time ``now`` (passed in, so a run is
    reproducible)."""
    return store.where(F.lit(now) - F.col("written_at") < ttl)


def hits(fps: DataFrame, store: DataFrame, now: int, ttl: int = DEFAULT_TTL_SEC) -> DataFrame:
    """Tables whose current content has a valid stored result."""
    v = valid(store, now, ttl).select("table_name", "mode", "content_hash").distinct()
    return fps.join(v, ["table_name", "mode", "content_hash"], "left_semi")


def misses(fps: DataFrame, store: DataFrame, now: int, ttl: int = DEFAULT_TTL_SEC) -> DataFrame:
    """Tables to (re)profile: no valid stored result for their content."""
    v = valid(store, now, ttl).select("table_name", "mode", "content_hash").distinct()
    return fps.join(v, ["table_name", "mode", "content_hash"], "left_anti")


def expire(spark, path: str, new_path: str, now: int, ttl: int = DEFAULT_TTL_SEC) -> DataFrame:
    """Keep only valid rows, written to a new version folder."""
    valid(spark.read.parquet(path), now, ttl).write.mode("overwrite") \
        .partitionBy("analysis_type").parquet(new_path)
    return spark.read.parquet(new_path)


def stats(store: DataFrame, now: int, ttl: int = DEFAULT_TTL_SEC) -> DataFrame:
    """Entries, valid, expired and payload megabytes."""
    ok = F.lit(now) - F.col("written_at") < ttl
    return store.agg(F.count(F.lit(1)).alias("entries"), F.count_if(ok).alias("valid"),
                     F.count_if(~ok).alias("expired"),
                     (F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)) / 1048576.0)
                     .alias("payload_mb"))


# ---------------------------------------------------------------------------
# Rows from which the reference's parsers stop reading whole files.
# ---------------------------------------------------------------------------
CSV_WHOLE_ROWS = 50000
XML_WHOLE_ROWS = 10000
# end of fixed values


def parse_facts(spark, paths: dict[str, str], cp: DataFrame) -> DataFrame:
    """Per table the stored size in MB (from the file listing, no content
    is read), the format its file names tell, the parse strategy the reference
    would use (long CSV 'chunked', long XML 'streaming', else 'full') and the structure
    of XML ('cadastral' when it has a cad_number column, null for other formats)."""
    from tablesense.sources.files import detect_format
    sizes = reduce(DataFrame.unionByName, [
        spark.read.format("binaryFile").load(p).select("length", detect_format(F.element_at(F.split("path", "/"), -1)).alias("format"))
        .agg(F.lit(t).alias("table_name"), (F.sum("length") / 1048576.0).alias("file_mb"), F.max("format").alias("format")) for t, p in paths.items()])
    facts = cp.groupBy("table_name").agg(
        F.max("row_count").alias("record_count"),
        F.bool_or(F.col("column_name").endswith("cad_number")).alias("_cad"))
    rows, fmt = F.col("record_count"), F.col("format")
    return sizes.join(facts, "table_name").select(
        "table_name", "file_mb", "format",
        F.when((fmt == "xml") & (rows >= XML_WHOLE_ROWS), "streaming").when((fmt == "csv") & (rows >= CSV_WHOLE_ROWS), "chunked").otherwise("full").alias("strategy"),
        F.when(fmt == "xml", F.when(F.col("_cad"), "cadastral").otherwise("generic")).alias("xml_structure"))
