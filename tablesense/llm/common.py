"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.session import scratch_path

# Rows per Arrow batch handed to Python: a batch of the longest texts of a
# web corpus (some hundred KB each) still fits beside numpy's work arrays.
ARROW_ROWS = 1000

# A frame of at most this many (id-sized) rows may be broadcast; a larger one
# is joined by shuffle. The count is taken from the written table.
BROADCAST_ROWS = 1_000_000
BROADCAST_NAMES = 50_000  # the same for rows that hold a host or source name

# Partitions for texts that make one of rows without them.
NARROW = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()  # applications whose executors have the package


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors (as --py-files would), so
    Python workers find them wherever they start. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"tablesense-{app}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name in ("tablesense/__init__.py", "tablesense/session.py"):
            z.write(os.path.join(root, name), name)
        for name in sorted(os.listdir(os.path.join(root, "tablesense", "llm"))):
            if name.endswith(".py"):
                z.write(os.path.join(root, "tablesense", "llm", name), f"tablesense/llm/{name}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session (a session setting: plans are
    lazy, so it can't be put back before the caller runs the frame), and see
    that Python workers have this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder and read
    it back. It survives the loss of executors. The shuffles behind it are
    freed with the write, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def narrow(df: DataFrame) -> DataFrame:
    """Fewer partitions, so fewer files, for rows without their texts: the
    session's partitions are meant for texts, which are some ten times as wide.
    For frames that come out of a shuffle; what is before it keeps its tasks."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(spark.sparkContext.defaultParallelism, n // NARROW))


def discard(*frames: DataFrame) -> None:
    """Delete written tables when all that is made of them is written too."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a written table of narrow rows if it holds at most
    ``limit`` rows; else leave the join to a shuffle, where AQE splits skew."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def fold(col: str, mod: int, keep: int):
    """crc32 of the id's decimal text, mod ``mod`` == ``keep``; a null id is in
    no held-out fold."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == keep, F.lit(False))


def word_count(col):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0. Each word,
    with the space behind it, becomes one letter: regexp_count would hold all
    words of a text at once, a string each."""
    letters = F.regexp_replace(col, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")
    return F.coalesce(F.length(F.ltrim(letters, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")
