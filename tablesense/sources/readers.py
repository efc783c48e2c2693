"""Readers for the reference's input formats.

Detection looks at all bytes of every file in one distributed pass; one row
per file comes back to the driver to configure the reader, which reads all of
the data: no row cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.sources import records as RC

# ---------------------------------------------------------------------------
# Candidate separators and encodings, in the reference's order.
# ---------------------------------------------------------------------------
SEPARATORS = [",", ";", "\t", "|"]
ENCODINGS = ["utf-8", "cp1251", "latin1"]
TAG_MIN_COUNT = 10
CADASTRAL_FIELDS = ["cad_number", "status", "last_container_fixed_at", "address", "coordinates",
                    "object_type", "area", "purpose"]
COORDINATE_TAGS = ["coordinates", "coord", "point", "location"]
# end of fixed values
CP1251_GAP = b"\x98"  # the byte that cp1251 gives no character
CORRUPT = "_corrupt_record"


def separator_of(first_line: Column) -> Column:
    """The first candidate separator in the header line, outside quotes."""
    bare = F.regexp_replace(first_line, '"[^"]*"', "")
    expr = F.when(F.lit(False), F.lit(None))
    for s in SEPARATORS:
        expr = expr.when(F.instr(bare, s) > 0, F.lit(s))
    return expr.otherwise(F.lit(","))


def detect_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, sep, encoding, multiline, header (a key: files of
    one key have the same header; the path where the header holds a line break).
    All bytes are looked at, in one pass of the splittable text reader (its
    lines keep their bytes): UTF-8 if every line is valid, else cp1251 unless a
    byte it lacks occurs, else latin1. A line with an odd number of quotes means
    that a quoted field holds a line break. The header is the first line that
    is not blank."""
    raw = F.col("value").cast("binary")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), "value", F.is_valid_utf8("value").alias("utf8"),
        F.contains(raw, F.lit(CP1251_GAP)).alias("gap"), (quotes % 2 == 1).alias("open"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    filled = F.when(F.col("value").rlike(r"[^\x00-\x20]"), F.col("at"))
    f = lines.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("gap").alias("gap"), F.bool_or("open").alias("multiline"),
                                  F.min_by("value", filled).alias("head"), F.min_by("open", filled).alias("cut"))
    return f.select("path", separator_of(F.col("head")).alias("sep"),
                    F.when(F.col("utf8"), ENCODINGS[0]).when(~F.col("gap"), ENCODINGS[1]).otherwise(ENCODINGS[2]).alias("encoding"), "multiline",
                    F.when(F.col("cut"), F.col("path")).otherwise(F.coalesce("head", F.lit(""))).cast("binary").alias("header"))


def _cp1251_letters() -> tuple[str, str]:
    """The characters numbered as cp1251's bytes, and the letters they stand for."""
    chars = [(chr(b), bytes([b]).decode("cp1251", "ignore")) for b in range(128, 256)]
    old, new = ("".join(x) for x in zip(*[(a, b) for a, b in chars if b], strict=True))
    return old, new


def _cp1251(df: DataFrame) -> DataFrame:
    """Columns and names of a latin1 read as cp1251: every byte has become the
    character of its number, which a translation turns into the letter."""
    old, new = _cp1251_letters()
    out = df.select(*[F.translate(F.col(f"`{c}`"), old, new).alias(c) for c in df.columns])
    return out.toDF(*[c.translate(str.maketrans(old, new)) for c in df.columns])


def _read_csv(spark: SparkSession, paths: list[str], sep: str, encoding: str, multiline: bool) -> DataFrame:
    latin = encoding != ENCODINGS[0]
    fields = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    r = spark.read.options(**fields).option("header", True).option("encoding", "ISO-8859-1" if latin else "UTF-8").option("enforceSchema", True)
    names = r.option("multiLine", multiline).csv(paths[0]).columns  # the header
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    if multiline:  # line breaks in quotes: records are cut by all tasks that have a split
        rows = RC.csv_records(spark, paths, "ISO-8859-1" if latin else None).where(~F.col("first"))
        ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names)
        df = rows.select(F.from_csv("value", ddl, fields).alias("r")).select("r.*")
    else:
        df = r.schema(schema).csv(paths)
    return _cp1251(df) if encoding == ENCODINGS[1] else df


def read_csv(spark: SparkSession, path: str, sep: str | None = None,
             encoding: str | None = None) -> DataFrame:
    """CSV with header; all columns as text (no inference, so codes
    like '061001' keep their zeros). Separator, encoding and line breaks in
    quotes are detected per file unless both are given; files that differ, also
    in their header, are read apart and united by column name. Lines with too many or too few fields
    are kept, their text in ``_corrupt_record`` (see ``corrupt_count``)."""
    both = sep is not None and encoding is not None
    kinds = (detect_csv(spark, path).groupBy("sep", "encoding", "multiline", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
             .drop("header").collect())  # the file listing
    if not kinds:  # no file has a line
        return spark.createDataFrame([], T.StructType([T.StructField(CORRUPT, T.StringType())]))
    parts = [_read_csv(spark, k["paths"], sep or k["sep"], encoding or k["encoding"], k["multiline"] and not both)
             for k in sorted(kinds, key=lambda k: k["paths"])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _parse(records: DataFrame, reader, method: str) -> DataFrame:
    """Records (one text each) read by Spark's parser of a format, which finds
    the schema of all of them if none is given."""
    jvm = records.sparkSession._jvm
    texts = getattr(records.select("value")._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING())
    return reader._df(getattr(reader._jreader, method)(texts))


def read_json(spark: SparkSession, path: str, multiline: bool = False,
              schema: T.StructType | str | None = None) -> DataFrame:
    """JSON Lines or, with ``multiline``, files that each hold an array
    of objects, one object, or objects on end, in any layout. Either way a file
    is read by as many tasks as it has splits. What is no object goes to
    ``_corrupt_record``; a file that holds a scalar is an error."""
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        r = r.schema(schema)
    return _parse(RC.json_records(spark, path), r, "json") if multiline else r.json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "item",
             schema: T.StructType | str | None = None, encoding: str = ENCODINGS[0]) -> DataFrame:
    """One row per ``row_tag`` element, attributes as ``_attr``
    fields, repeated children as arrays. Values stay text unless a schema
    is given. Records are cut out of the text before they are parsed, so a broken
    one goes to ``_corrupt_record`` and its neighbours are read. Row elements
    do not nest; an end tag of theirs in a comment or CDATA section breaks its
    record. ``encoding``: one of ``ENCODINGS``."""
    r = (spark.read.option("rowTag", row_tag).option("inferSchema", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if schema is not None:
        r = r.schema(schema)
    records = RC.xml_records(spark, path, row_tag, None if encoding == ENCODINGS[0] else "ISO-8859-1")
    if encoding == ENCODINGS[1]:
        records = records.withColumn("value", F.translate("value", *_cp1251_letters()))
    return _parse(records, r, "xml")


def without_corrupt(df: DataFrame) -> DataFrame:
    if CORRUPT in df.columns:
        return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return df


def corrupt_count(df: DataFrame) -> DataFrame:
    """(records, corrupt, content_hash) of a text-format read: the number of
    records, of corrupt ones, and an order-independent hash of the good
    ones. (Spark rejects a query that needs only the corrupt-record column;
    the content hash reads every column, which the parse does anyway.)"""
    cols = [F.col(f"`{c}`") for c in df.columns if c != CORRUPT]
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("corrupt"),
                  F.coalesce(F.sum(F.when(~bad, h)), F.lit(0)).cast("string").alias("content_hash"))


def find_field(schema: T.StructType, name: str) -> Column | None:
    """Text of the first field called ``name`` that a row holds, wherever it
    is: all places of the name in the schema are tried, a field before its
    children, children before what follows, and the elements of an array one
    after the other; the first that is not null wins. Of an element
    with attributes or children it is the text among them. None if the schema
    has no such field."""

    def text(dt: T.DataType, c: Column) -> Column | None:
        """The text of the named field itself."""
        if isinstance(dt, T.ArrayType):
            return first(dt, c, text)
        if isinstance(dt, T.StructType):
            return c["_VALUE"].cast("string") if "_VALUE" in dt.names else None
        return c.cast("string")

    def within(dt: T.DataType, c: Column) -> Column | None:
        """The named field within a value."""
        if isinstance(dt, T.ArrayType):
            return first(dt, c, within)
        if not isinstance(dt, T.StructType):
            return None
        found = [x for f in dt.fields for x in ([text(f.dataType, c.getField(f.name))] if f.name == name else []) + [within(f.dataType, c.getField(f.name))]]
        found = [x for x in found if x is not None]
        return F.coalesce(*found) if found else None

    def first(dt: T.ArrayType, c: Column, what) -> Column | None:
        if what(dt.elementType, F.lit(None)) is None:
            return None
        return F.get(F.filter(F.transform(c, lambda e: what(dt.elementType, e)), lambda v: v.isNotNull()), 0)

    tops = [x for f in schema.fields for x in ([text(f.dataType, _col(f.name))] if f.name == name else []) + [within(f.dataType, _col(f.name))]]
    tops = [x for x in tops if x is not None]
    return F.coalesce(*tops) if tops else None


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def cadastral_projection(df: DataFrame) -> DataFrame:
    """The eight cadastral fields wherever a record holds them; ``area`` as a
    number when it parses, with its text kept."""
    cols = []
    for name in CADASTRAL_FIELDS:
        found = find_field(df.schema, name)
        c = F.lit(None).cast("string") if found is None else found
        if name == "area":
            cols += [c.try_cast("double").alias("area"), c.alias("area_text")]
        else:
            cols.append(c.alias(name))
    return df.select(*cols)


def split_coordinates(df: DataFrame) -> DataFrame:
    """The first coordinate-like field with a text; 'a,b' gives latitude and
    longitude text, anything else goes to ``coordinates_raw``."""
    found = [F.nullif(c, F.lit("")) for c in (find_field(df.schema, t) for t in COORDINATE_TAGS) if c is not None]
    raw = F.coalesce(*found) if found else F.lit(None).cast("string")
    pair = raw.contains(",")
    parts = F.split(raw, ",")
    return df.select("*",
                     F.when(pair, F.trim(F.get(parts, 0))).alias("latitude"),
                     F.when(pair, F.trim(F.get(parts, 1))).alias("longitude"),
                     F.when(~pair, raw).alias("coordinates_raw"))


def tag_discovery(df: DataFrame, key: str, text: str, min_count: int = TAG_MIN_COUNT) -> DataFrame:
    """(key, tag, count): element names used more than ``min_count`` times
    within one document, without the document's root (its first element):
    record candidates. Row-local: a document's tags are counted in its row."""
    tags = F.regexp_extract_all(F.col(text), F.lit("<([A-Za-z][A-Za-z0-9_.:-]*)"), 1)
    found = df.select(key, tags.alias("tags")).select(key, "tags", F.explode(F.array_distinct("tags")).alias("tag"))
    n = F.size(F.filter("tags", lambda x: x == F.col("tag")))
    return found.where((n > min_count) & (F.col("tag") != F.get("tags", 0))).select(key, "tag", n.alias("count"))
