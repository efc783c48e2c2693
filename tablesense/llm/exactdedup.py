"""Exact deduplication with streaming state (operator 9), DataFrames only.

1. Every row is reduced to an arrival: the digest of its (normalised) text,
   its stable identifier and its content locator (file and row number of the
   scan, not a place in the file; it is stored but never read).
   Arrivals are written to the shared folder.
2. A Structured Streaming query reads the arrivals and keeps, per digest, a
   RocksDB-backed state without expiry: the identifier and locator of the row
   that stays and the number of rows seen. A restart from the same checkpoint
   goes on where it stopped; later arrivals find the digests of earlier runs.
3. The state is read back through the state data source. Digests seen more
   than once are hits: their rows are grouped by the full text, so that texts
   which merely share a digest are found and told apart.

Partial aggregation before every shuffle reduces a group of copies to one row
per task; the rows themselves are only joined to the table of hits. Only texts
of hits are shuffled, one per task and distinct text.

Defined results: a null text counts as empty; of equal texts the row with the
largest identifier stays (a null identifier only if there is no other), of rows
that share text and identifier any one, so exactly one row of a group is
``kept``; an empty table gives an empty result; extra columns stay, columns
named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesense.llm.common import maybe_broadcast, written
from tablesense.session import scratch_path

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many partitions with a small store each: take no disk before it is needed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digested(docs: DataFrame, id_col: str, text: str, digest) -> DataFrame:
    """docs plus __i (identifier), __t (text, null as empty), __d (digest)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("__i", F.col(id_col)).withColumn("__t", t).withColumn("__d", digest(t))


def run_state(spark: SparkSession, arrivals: str, checkpoint: str, schema) -> None:
    """Feed the arrivals not yet seen by ``checkpoint`` to its keyed state."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = (spark.readStream.schema(schema).parquet(arrivals)
                 .groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n")))
        query = (state.writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, at (identifier and locator of the row that stays), n."""
    st = spark.read.format("statestore").load(checkpoint)
    return st.select(F.col("key")["digest"].alias("digest"), F.col("value").getItem("max").alias("at"),
                     F.col("value").getItem("count").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest=sha256,
                checkpoint: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its columns, keep_id, group_size, kept and
    text_sha256. ``digest`` may be any function of the text; equal digests of
    different texts cost time, never a wrong group."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in RESULTS if c != id_col and c != text])
    rows = digested(docs, id_col, text, digest)
    arrivals = scratch_path(spark, "llm-arrivals")
    slim = rows.select(F.col("__d").alias("digest"), F.struct(
        F.col("__i").alias("id"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).alias("at"))
    slim.write.parquet(arrivals)
    checkpoint = checkpoint or scratch_path(spark, "llm-dedup-state")
    run_state(spark, arrivals, checkpoint, slim.schema)

    hits = written(read_state(spark, checkpoint).where("n > 1").select(
        F.col("digest").alias("__h"), F.col("at")["id"].alias("__keep"), F.col("n").alias("__n")), "hits")
    small = maybe_broadcast(hits)
    match = F.col("__d") == F.col("__h")
    checked = rows.join(small, match, "left_semi").groupBy("__d", "__t").agg(F.max("__i").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    clashes = written(checked.groupBy(F.col("__d").alias("__c")).count().where("count > 1").select("__c"), "clashes")
    if clashes.isEmpty():
        found = rows.join(small, match, "left")
    else:  # digests that several texts share: grouped by the text itself
        shared = F.col("__d") == F.col("__c")
        groups = written(checked.join(clashes, shared, "left_semi").select(
            F.col("__d").alias("__h"), F.col("__t").alias("__ht"), "__keep", "__n"), "clash-groups")
        both = rows.join(clashes, shared, "left_semi").join(groups, match & (F.col("__t") == F.col("__ht")))
        found = both.drop("__ht").unionByName(rows.join(clashes, shared, "left_anti").join(small, match, "left"))
    n = F.coalesce("__n", F.lit(1)).cast("long")
    out = found.select(
        *[F.col(c) for c in docs.columns], F.when(n > 1, F.col("__keep")).otherwise(F.col("__i")).alias("keep_id"),
        n.alias("group_size"), F.when(n > 1, F.col("__i").eqNullSafe(F.col("__keep"))).otherwise(F.lit(True)).alias("kept"),
        F.sha2("__t", 256).alias("text_sha256"))

    # Rows that repeat text and identifier: one of them is kept. Usually none.
    last = out.where("kept AND group_size > 1").groupBy("text_sha256", "keep_id").count().where("count > 1")
    ties = written(last.select(F.col("text_sha256").alias("__s")), "ties")
    if ties.isEmpty():
        return out
    tied = (F.col("text_sha256") == F.col("__s")) & F.col("kept")
    first = Window.partitionBy("text_sha256").orderBy("__p")  # first one per task, then of those
    some = (out.join(ties, tied, "left_semi").withColumn("__p", F.spark_partition_id())
            .withColumn("__r", F.row_number().over(Window.partitionBy("text_sha256", "__p").orderBy("__p"))))
    rest = some.where("__r > 1").withColumn("kept", F.lit(False)).select(*out.columns)
    one = some.where("__r = 1").withColumn("kept", F.row_number().over(first) == 1).select(*out.columns)
    return out.join(ties, tied, "left_anti").unionByName(rest).unionByName(one)
