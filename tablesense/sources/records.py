"""Records cut out of text files whose lines are not records.

A CSV file with line breaks in quotes, a JSON array and an XML document are
read by as many tasks as they have splits. The text reader cuts a file into
pieces at a separator (line feed, ``}``, the end tag of a record); a separator
ends a record only in the right state: outside quotes and, in JSON, at the
depth of the records.

1. A first pass adds up, for every split, what it does to the state from
   either start (number of quotes, change of depth) and its bytes. Running sums
   over a file's splits give the state with which each split begins, and tell
   whether the file's last piece lacks its separator.
2. A second pass streams each split's pieces in order and joins them to records.
3. A record that crosses splits leaves a fragment in each; the fragments of a
   file, at most two a split, are put together. This pass is skipped if no
   split begins within a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesense.session import materialize

SPLIT_ROWS = 1_000_000  # so many splits (a short row each) may be broadcast
CODECS = r"\.(gz|bz2|deflate|zst|snappy|lz4)$"
PIECE = "path string, split long, fragment boolean, opens boolean, place int, first boolean, value binary"


def _pieces(spark: SparkSession, path, sep: str, encoding: str | None = None) -> DataFrame:
    """path, split (its first byte), at (order within the split), size of the file, bytes and value of each piece."""
    value = F.col("value") if encoding is None else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("bytes"), value.alias("value"))


def _splits(sums: DataFrame, sep: str) -> DataFrame:
    """One row per split of sums (path, split, q, d0, d1, bytes with separators, size,
    base, and ``unsure``: whether a compressed file, whose size says nothing,
    is taken to end without separator): its state at the start (q0, dep0),
    ``tail`` (its last piece ends the file without separator), ``inside`` (it
    begins within a record) and ``cut`` (the file ends within a record)."""
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path")
    s = sums.withColumn("q0", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    s = s.withColumn("d", F.when(F.col("q0") == 0, F.col("d0")).otherwise(F.col("d1")))
    s = s.withColumn("dep0", F.coalesce(F.sum("d").over(before), F.lit(0)))
    last = F.col("split") == F.max("split").over(file)
    unsure = F.when(F.col("path").rlike(CODECS), F.col("unsure") | (F.sum("d").over(file) != 0)).otherwise(
        (F.sum("bytes").over(file) - F.col("size")).isin(len(sep.encode()), len(sep.encode()) - 3))  # the reader leaves out a byte order mark
    s = s.withColumn("tail", last & unsure)
    in_record = lambda q, d: (q % 2 == 1) | (d > F.col("base"))
    return materialize(s.select("path", "split", F.col("q0").cast("int"), F.col("dep0").cast("long"), F.col("base").cast("long"), "tail",
                                in_record(F.col("q0"), F.col("dep0")).alias("inside"),
                                (last & ~F.col("tail") & in_record(F.col("q0") + F.col("q"), F.col("dep0") + F.col("d"))).alias("cut")))


def _cut(pieces: DataFrame, splits: DataFrame, sep: bytes, closes: bool, end: bytes) -> DataFrame:
    """The records and fragments (PIECE) of pieces (path, split, at, q, d0, d1,
    value). ``closes``: the separator lowers the depth by one; ``end`` is what
    it leaves at the end of a record."""
    joined = pieces.join(F.broadcast(splits), ["path", "split"])
    if splits.count() > SPLIT_ROWS:
        joined = pieces.join(splits, ["path", "split"]).repartition("path", "split").sortWithinPartitions("path", "split", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key = last = None     # the split at hand; its latest piece, kept back: only the next one shows that it was not the last
        held: list = []       # pieces of the record at hand
        seen = inside = False  # a record of the split has been given; the record at hand began in an earlier split
        par = dep = 0
        out: list = []

        def give(text, done):
            nonlocal seen, inside
            first = not seen and key[1] == 0
            if done and not inside:
                if text.strip():
                    out.append((*key, False, False, 0, first, text))
                    seen = True
            else:
                out.append((*key, True, not inside, 0 if inside else 1, first, text))
                seen = True
            inside = False

        def take(value, stop):
            held.append(value)
            if stop:
                text = sep.join(held) + end
                held.clear()
                give(text, True)

        def close(tail):
            """The end of a split: its last piece, and a record that goes on."""
            nonlocal last
            if last is not None:
                if tail:
                    held.append(last[0])
                    text = sep.join(held)
                    held.clear()
                    give(text, not inside)
                else:
                    take(*last)
                last = None
            if held:
                text = sep.join(held) + (end if cut else b"")
                held.clear()
                give(text, False)

        def flush():
            rows = list(zip(*out, strict=True))
            out.clear()
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                                              names=["path", "split", "fragment", "opens", "place", "first", "value"])

        tail = cut = False
        for batch in batches:
            paths, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            q, d0, d1 = (batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (2, 3, 4))
            values = batch.column(10).to_pylist()
            lo = 0
            while lo < len(paths):
                hi = lo
                while hi < len(paths) and at[hi] == at[lo] and paths[hi] == paths[lo]:
                    hi += 1
                if (paths[lo], at[lo]) != key:
                    if key is not None:
                        close(tail)
                    cut = batch.column(9)[lo].as_py()
                    key, seen = (paths[lo], at[lo]), False
                    par, dep = batch.column(5)[lo].as_py(), batch.column(6)[lo].as_py()
                    tail = batch.column(8)[lo].as_py()
                    inside = par == 1 or dep > batch.column(7)[lo].as_py()
                base = batch.column(7)[lo].as_py()
                after = par + np.cumsum(q[lo:hi])
                was = np.concatenate([[par], after[:-1]]) % 2
                step = np.where(was == 0, d0[lo:hi], d1[lo:hi])
                if closes:
                    step = step - (after % 2 == 0)
                deep = dep + np.cumsum(step)
                stops = ((after % 2 == 0) & (deep <= base)).tolist()
                par, dep = int(after[-1] % 2), int(deep[-1])
                for value, stop in zip(values[lo:hi], stops, strict=True):
                    if last is not None:
                        take(*last)
                    last = (value, stop)
                lo = hi
            if out:
                yield flush()
        if key is not None:
            close(tail)
        if out:
            yield flush()

    cols = ["path", "split", "q", "d0", "d1", "q0", "dep0", "base", "tail", "cut", F.col("value").cast("binary").alias("value")]
    cut = joined.select(*cols).mapInArrow(run, PIECE)
    whole = cut.where(~F.col("fragment")).select("path", "split", "first", "value")
    if splits.where("inside OR cut").isEmpty():
        return whole
    order = Window.partitionBy("path").orderBy("split", "place")
    parts = cut.where("fragment").withColumn("n", F.sum(F.col("opens").cast("int")).over(order))
    text = lambda x: x["value"].cast("string")  # noqa: E731  (the same bytes)
    joined_parts = parts.groupBy("path", "n").agg(F.min("split").alias("split"), F.bool_or("first").alias("first"),
                                                  F.sort_array(F.collect_list(F.struct("split", "place", "value"))).alias("s"))
    return whole.unionByName(joined_parts.select("path", "split", "first", F.array_join(F.transform("s", text), sep.decode()).cast("binary").alias("value")))


def csv_records(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """path, first (the record heads its file), value: the records of CSV files
    that may hold line breaks in quotes. Blank records are left out. A line
    feed ends a line, with or without carriage return before it; so does a
    carriage return on its own."""
    pieces = _pieces(spark, path, "\n", encoding)
    alone = r"\r(?!\z)"
    counted = pieces.withColumn("q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    sums = materialize(counted.groupBy("path", "split").agg(F.sum("q").alias("q"), F.lit(0).alias("d0"), F.lit(0).alias("d1"), F.max("size").alias("size"),
                                                            F.lit(0).alias("base"), F.lit(True).alias("unsure"), F.sum(F.col("bytes") + 1).alias("bytes"), F.bool_or(F.col("value").rlike(alone)).alias("mac")))
    splits = _splits(sums, "\n")
    zero = F.lit(0)
    cut = _cut(counted.withColumn("d0", zero).withColumn("d1", zero), splits, b"\n", False, b"")
    out = cut.select("path", "split", "first", F.regexp_replace(F.col("value").cast("string"), r"\r\z", "").alias("value"))
    if sums.where("mac").isEmpty():
        return out.drop("split")
    # Lone carriage returns outside quotes end records too: cut behind an even number of quotes.
    even = "\r(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
    rows = out.select("path", "first", F.posexplode(F.split("value", even)).alias("place", "value")).where(F.trim("value") != "")
    return rows.select("path", (F.col("first") & (F.col("place") == 0)).alias("first"), "value")


def _json_counts(pieces: DataFrame) -> DataFrame:
    """q: quotes of a piece; d0, d1: its change of depth if it begins outside or
    within a string."""
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    p = pieces.withColumn("__p", parts)
    n = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    depth = lambda s: n(s, "[{") - n(s, "]}")
    side = lambda k: F.array_join(F.filter("__p", lambda x, i: i % 2 == k), "")
    return p.withColumn("q", F.size("__p") - 1).withColumn("d0", depth(side(0))).withColumn("d1", depth(side(1))).drop("__p")


def json_records(spark: SparkSession, path) -> DataFrame:
    """path, value: the objects of JSON files, each an array of objects, one
    object, or several of either on end. What stands between them is a record of its own
    (which will not parse). A file that holds another value is an error."""
    counted = _json_counts(_pieces(spark, path, "}"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums: dict = {}
        for batch in batches:
            paths, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            q, d0, d1 = (batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (2, 3, 4))
            lo = 0
            while lo < len(paths):
                hi = lo
                while hi < len(paths) and at[hi] == at[lo] and paths[hi] == paths[lo]:
                    hi += 1
                s = sums.setdefault((paths[lo], at[lo]), [0, 0, 0])
                after = s[0] + np.cumsum(q[lo:hi])
                was = np.concatenate([[s[0]], after[:-1]]) % 2
                for k, (a, b) in enumerate(((d0, d1), (d1, d0)), 1):  # begun outside, begun within a string
                    s[k] += int((np.where(was == 0, a[lo:hi], b[lo:hi]) - (after % 2 == k - 1)).sum())
                s[0] = int(after[-1])
                lo = hi
        rows = [(*key, *s) for key, s in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "split", "q", "d0", "d1"])

    states = counted.select("path", "split", "q", "d0", "d1").mapInArrow(add, "path string, split long, q long, d0 long, d1 long")
    lead = F.regexp_extract("value", r"^[\s\x{FEFF}]*([^\s\x{FEFF}])", 1)
    sizes = counted.groupBy("path", "split").agg(F.sum(F.col("bytes") + 1).alias("bytes"), F.max("size").alias("size"),
                                                 F.min_by(lead, F.when(lead != "", F.col("at"))).alias("lead"))
    sums = materialize(states.join(sizes, ["path", "split"]))
    root = F.min_by("lead", F.when(F.col("lead") != "", F.col("split")))
    wrong = sums.groupBy("path").agg(root.alias("lead")).where("lead NOT IN ('[', '{')").orderBy("path").limit(3).collect()
    if wrong:
        raise ValueError("neither an object nor an array of objects: " + ", ".join(r["path"] for r in wrong))
    begins = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    array = F.first(F.when(F.col("lead") != "", F.col("lead")), ignorenulls=True).over(begins) == "["
    splits = _splits(sums.withColumn("base", F.when(array, 1).otherwise(0)).withColumn("unsure", F.lit(False)), "}")
    cut = _cut(counted, splits, b"}", True, b"}").select("path", F.col("value").cast("string").alias("value"))
    # Around objects stand white space, commas and the brackets of the array.
    before = F.regexp_replace(F.regexp_extract("value", r"(?s)^([^{]*)", 1), r"^[\s,\x{FEFF}]*\]?[\s,]*\[?[\s,]*", "")
    rest = F.regexp_extract("value", r"(?s)^[^{]*(.*)$", 1)
    parts = F.array(F.regexp_replace(before, F.when(rest == "", r"[\s,]*\]?\s*\z").otherwise(r"[\s,]+\z"), F.lit("")), rest)
    return cut.select("path", F.explode(parts).alias("value")).where("value <> ''")


def xml_records(spark: SparkSession, path, row_tag: str, encoding: str | None = None) -> DataFrame:
    """path, value: the text of every ``row_tag`` element. An element without
    end tag, or an end tag without start, is a record of its own (which will not
    parse), and the next start tag begins anew: a broken record costs none of
    its neighbours. An element within another of the same name is a record; the
    outer one then is broken."""
    tag = re.escape(row_tag)
    end = f"</{row_tag}>"
    pieces = _pieces(spark, path, end, encoding)
    zero = F.lit(0)
    counted = pieces.withColumn("q", zero).withColumn("d0", zero).withColumn("d1", zero)
    sums = counted.groupBy("path", "split").agg(*[F.sum(c).alias(c) for c in ("q", "d0", "d1")], F.max("size").alias("size"),
                                                zero.alias("base"), F.lit(True).alias("unsure"), F.sum(F.col("bytes") + len(end.encode())).alias("bytes"))
    cut = _cut(counted, _splits(sums, end), b"", False, end.encode()).select("path", F.col("value").cast("string").alias("value"))
    parts = F.split("value", rf"(?=<{tag}[\s/>])")
    closed = rf"(?s)^(.*</{tag}\s*>|<{tag}(?:\s[^>]*)?/>)"  # to its end tag, or without content

    def whole(x: Column) -> Column:
        found = F.regexp_extract(x, closed, 1)
        return F.when(found != "", found).otherwise(x)

    starts = F.filter(parts, lambda x: x.rlike(rf"^<{tag}[\s/>]"))
    lost = F.filter(parts, lambda x, i: (i == 0) & ~x.rlike(rf"^<{tag}[\s/>]") & x.endswith(end))
    return cut.select("path", F.explode(F.concat(lost, F.transform(starts, whole))).alias("value"))
