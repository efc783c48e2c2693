"""Sinks (K1, K2): the date-partitioned archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = ["year", "month", "day"]


def archive_partitioned(df: DataFrame, ts: str, path: str, batch: str = "0", fmt: str = "parquet",
                        codec: str | None = None, tasks: int | None = None) -> None:
    """K2: add a batch to the archive under year=/month=/day=/batch= folders.
    Days and batches already there stay: a late day is one more folder beside the
    earlier ones of that day. A batch that is written again replaces itself,
    also on days for which it has no rows any more. The rebalance hint brings a
    day's rows together, so tasks do not write a small file to every day, and
    lets adaptive execution split a big day over several tasks and files; for
    many days of few rows, which it would give to one task, ``tasks`` deals the
    days to so many."""
    out = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).withColumn("day", F.dayofmonth(ts)).withColumn("batch", F.lit(batch))
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("batch", batch)
    glob = "/".join([*[f"{c}=*" for c in DAY], name.replace("*", "\\*").replace("[", "\\[").replace("{", "\\{").replace("?", "\\?")])
    before = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, glob)) or []
    dealt = out.repartition(tasks, *DAY) if tasks else out.hint("rebalance", *DAY)
    w = (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*DAY, "batch").format(fmt))
    if codec:
        w = w.option("compression", codec)
    w.save(path)
    if before:  # days that only the earlier run of this batch had
        days = {tuple(r) for r in out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) for c in DAY]).distinct().collect()}
        for status in before:
            folder = status.getPath()
            parts = folder.toString().split("/")[-4:-1]
            if tuple(p.split("=", 1)[1] for p in parts) not in days:
                files.delete(folder, True)
