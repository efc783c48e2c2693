"""File-level operators: format detection, admission checks, structure
counters and content fingerprints (S17-S20, C1).

Sizes come from ``binaryFile`` without its content column, lines from the text
reader, so no file body is held whole. ``store.fingerprints`` is the fingerprint
of a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Extensions and limits of the reference's file validator.
# ---------------------------------------------------------------------------
EXTENSIONS = {"csv": [".csv", ".txt"], "json": [".json", ".jsonl"], "xml": [".xml", ".xsd"]}
MIN_BYTES, MAX_BYTES = 1, 10 * 1024 * 1024 * 1024
# end of fixed values


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path segment ('' when none); query
    strings and fragments are ignored."""
    bare = F.regexp_replace(path, "[?#].*$", "")
    return F.lower(F.regexp_extract(bare, "(\\.[A-Za-z0-9]+)$", 1))


def detect_format(path: Column) -> Column:
    """By extension, else by keyword in the name (csv/data, json, xml),
    else 'unknown'."""
    ext = extension(path)
    low = F.lower(path)
    expr = F.when(F.lit(False), F.lit(None))
    for fmt, exts in EXTENSIONS.items():
        expr = expr.when(ext.isin(*exts), F.lit(fmt))
    return (expr.when(low.rlike("csv|data"), "csv").when(low.contains("json"), "json")
                .when(low.contains("xml"), "xml").otherwise("unknown"))


def first_line_ok(fmt: Column, first_line: Column) -> Column:
    """CSV has a separator, JSON starts with '[' or '{', XML with '<'."""
    line = F.trim(first_line)
    return (F.when(fmt == "csv", (line != "") & line.rlike("[;,\\t]"))
             .when(fmt == "json", F.substring(line, 1, 1).isin("[", "{"))
             .when(fmt == "xml", line.startswith("<"))
             .otherwise(F.lit(False)))


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, first_line) of every file, by the splittable text reader: the
    first line of the block at its start, which one task reads in order. So no
    line is sorted or held beyond its batch."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at = batch.column(0).dictionary_encode()
            for n, name in enumerate(at.dictionary.to_pylist()):
                if name not in seen:
                    seen.add(name)
                    yield batch.slice(pc.index(at.indices, n).as_py(), 1)

    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("first_line")).mapInArrow(
        first, "path string, first_line string")


def admission(spark: SparkSession, path: str, declared: str | None = None) -> DataFrame:
    """One row per file with its format and the list of violations. File
    sizes come from the listing; contents are only read as lines."""
    binary = spark.read.format("binaryFile").load(path)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    seen = binary.select(bare("path").alias("_p"), "length")
    # Readers skip files without bytes; the listing has them.
    listed = spark.createDataFrame([(f,) for f in binary.inputFiles()], "path string").withColumn("_p", bare("path"))
    files = listed.join(seen, "_p", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    first = first_lines(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("_p"), "first_line")
    fmt = F.lit(declared) if declared else detect_format(F.col("path"))
    ext_ok = F.lit(True)
    if declared:
        ext_ok = extension(F.col("path")).isin(*EXTENSIONS[declared])
    violations = F.array_compact(F.array(
        F.when(F.col("length") < MIN_BYTES, F.lit("empty file")),
        F.when(F.col("length") > MAX_BYTES, F.lit("file too large")),
        F.when(fmt == "unknown", F.lit("unknown format")),
        F.when(~ext_ok, F.lit("extension does not match format")),
        F.when(~first_line_ok(fmt, F.coalesce("first_line", F.lit(""))), F.lit("bad first line")),
    ))
    return files.join(first, "_p", "left").select(
        "path", "length", fmt.alias("format"), violations.alias("violations"), (F.size(violations) == 0).alias("admitted"))


def structure_counts(df: DataFrame, text: str) -> DataFrame:
    """Line counts of a text column: all lines, lines starting with '{',
    lines holding '<item>'."""
    lines = F.split(F.col(text), "\n")
    return df.agg(
        F.sum(F.size(lines)).cast("long").alias("lines"),
        F.sum(F.size(F.filter(lines, lambda x: x.startswith("{")))).cast("long").alias("brace_lines"),
        F.sum(F.size(F.filter(lines, lambda x: x.contains("<item>")))).cast("long").alias("item_lines"),
    )


def content_fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """md5 of each text and its size in bytes."""
    return df.select(key, F.md5(F.col(text)).alias("content_md5"),
                     F.octet_length(F.col(text)).cast("long").alias("size_bytes"))
