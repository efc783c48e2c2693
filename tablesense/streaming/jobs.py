"""Streaming twins of batch operators.

Both read a file source (new files are new input), run with
``trigger(availableNow=True)`` so a run processes what is there and stops,
and keep their progress in a checkpoint folder under the shared
checkpoint directory, so a restarted run resumes instead of recomputing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.operators import design as D
from tablesense.operators import profile as P
from tablesense.operators import store as S
from tablesense.session import materialize


def file_stream(spark: SparkSession, folder: str, glob: str, schema, max_files: int | None = None
                ) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def daily_rollup_stream(spark: SparkSession, stream: DataFrame, table: str, out: str,
                        checkpoint: str) -> DataFrame:
    """The A21 roll-up maintained incrementally.

    Every micro-batch writes its own sums by day to a folder of its own (a
    batch that is run again replaces it); the reader adds them up. So there is
    no state, no watermark, and a late day counts like any other.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        D.daily_rollup_tall(batch, table).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return (spark.read.parquet(out).groupBy("table_name", F.date_format("date", "yyyy-MM-dd").alias("date"), "column_name")
            .agg(F.sum("total").cast("decimal(38,10)").alias("total")))


def profile_stream(spark: SparkSession, stream: DataFrame, table: str, out: str,
                   checkpoint: str) -> DataFrame:
    """Every micro-batch of new files is profiled, its profile written to a
    folder of its own; the reader merges them into the table's profile: counts
    and sizes are added, ranges widened, flags combined, distinct sketches
    united."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        P.catalog_column_profile({table: batch}, "sketch").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    if not _exists(spark, f"{out}/batch=*"):  # no file has come yet
        return merge_profiles(P.catalog_column_profile({table: spark.createDataFrame([], stream.schema)}, "sketch"))
    return merge_profiles(spark.read.parquet(out))


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def row_counts_stream(spark: SparkSession, stream: DataFrame, checkpoint: str) -> DataFrame:
    """How often every distinct row was seen: (h, h2, count), a 128-bit hash of
    the row and its count. The counts are the state of a streaming aggregation,
    so a run touches only the keys of its new files; no row is kept, and the
    result is read from the state as the last batch committed it."""
    rows = stream.select(P.row_hash(stream).alias("h"), P.row_hash(stream, seed=7).alias("h2"))
    q = (rows.groupBy("h", "h2").count().writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if not _exists(spark, f"{checkpoint}/commits/[0-9]*"):
        return spark.createDataFrame([], "h long, h2 long, count long")
    return spark.read.format("statestore").load(checkpoint).select("key.h", "key.h2", "value.count")


def table_profile_stream(spark: SparkSession, stream: DataFrame, table: str, out: str, checkpoint: str,
                         store: str | None = None, now: int | None = None) -> DataFrame:
    """The table profile of all files so far, with duplicate rows and quality
    score (those of the batch profile) and the content's fingerprint. With
    ``store`` and ``now`` it is also added to the profile store, where a
    batch job over the same rows finds it within its time to live.

    Measures and row counts are two streams over the same files; a file that
    comes between their runs is in the second only, so both run until they
    agree on the number of rows."""
    for _ in range(5):
        counts = row_counts_stream(spark, stream, f"{checkpoint}/rows")
        cp = materialize(profile_stream(spark, stream, table, out, f"{checkpoint}/measures"))
        facts = materialize(counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
                                       F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))
        if facts.first().rows == cp.first().row_count:
            break
    else:
        raise RuntimeError("files keep coming between the two runs")
    fp = materialize(S.counted_fingerprint(counts, table))
    tp = P.table_profile(cp.withColumn("distinct_count", F.col("distinct_estimate")),
                         facts.select(F.lit(table).alias("table_name"), "duplicate_rows"))
    if store is not None:
        S.write(S.entries(tp, fp, "table_profile", now), store)
    return tp.join(F.broadcast(fp.select("table_name", "content_hash")), "table_name")  # one row


def merge_profiles(parts: DataFrame) -> DataFrame:
    """One profile row per column from profiles of disjoint parts of a table."""
    some = F.col("row_count") > F.col("null_count")
    date_forms = F.bit_and(F.when(some, F.col("date_forms")))  # the forms that the values of all parts have
    day = (date_forms.bitwiseAND(24) == 16) | (date_forms.bitwiseAND(96) == 64)
    return parts.groupBy("table_name", "ordinal", "column_name", "kind").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("row_count", "null_count", "byte_size")],
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))), F.lit(0)).alias("distinct_estimate"),
        F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        date_forms.alias("date_forms"), F.min("day_min").alias("day_min"), F.max("day_max").alias("day_max"),
        F.when(day, F.min("day_min")).otherwise(F.min("ts_min")).alias("ts_min"),
        F.when(day, F.max("day_max")).otherwise(F.max("ts_max")).alias("ts_max"),
        F.bool_or("numeric_hit").alias("numeric_hit"), F.bool_or("nested_hit").alias("nested_hit"),
        F.bool_or("from_struct").alias("from_struct"), F.max("f32_err").alias("f32_err"),
        F.coalesce(F.when(F.col("kind") == "string", date_forms != 0).otherwise(F.bool_and(F.when(some, F.col("timestamp_ok")))), F.lit(False)).alias("timestamp_ok"))
