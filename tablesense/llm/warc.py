"""WARC archives with segment reassembly (operator 11).

Writing: one record per page, its block an HTTP response in chunked transfer
framing. Of equal payloads of at least ``least_shared`` bytes, the page with
the largest identifier is the ``response``; the others are ``revisit`` records
that refer to it. A block longer than ``segment`` bytes is cut: the record has
segment number 1, ``continuation`` records carry the rest with the origin's
identifier, and the last one the total length. Every task streams its records
into one gzip file through Spark's text writer, whose line separator is the
end of a record, so any shared folder that Spark can write will do.

Reading: Spark's text reader cuts archives at the version mark that opens a
record; a piece is checked against its declared length, and joined with the
next ones if its block holds the mark itself (chunks are cut so that own
blocks never do). Whole records are decoded where they are read. Segments are
grouped by the origin's identifier and ordered by number; all numbers must be
there and the lengths must add up to the declared total. Only segments are
shuffled, and a group is one record. Revisits are resolved by a join of
identifiers and sizes, without payloads.

A group of copies may be of any size: it is reduced by partial aggregation to
one row, and its revisits are narrow rows; joins to it are broadcast up to
a counted size, beyond it shuffled, where adaptive execution splits a hot key.

Defined results: a null payload is empty; a null url or identifier gives a record
without that field; payloads below the limit are always responses; of repeated
rows (equal payload and largest identifier) any one is the response; an empty
table gives empty archives and no records; extra columns are not archived and
may have any name. Records that can't be restored are kept with a ``status``:
``malformed`` (no header or length), ``short`` (block shorter than declared),
``segments missing``, ``length differs``, ``bad framing``, ``digest differs``;
their payload is null. A segment that occurs twice counts once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.llm.common import maybe_broadcast, small_batches, written
from tablesense.session import scratch_path

LEAST_SHARED = 1000   # bytes; smaller payloads are written again
SEGMENT = 16_384      # bytes of a block in one record
CHUNK = 4_096         # bytes of a chunk of the transfer framing

# ---------------------------------------------------------------------------
# Fixed values of the archive format.
# ---------------------------------------------------------------------------
VERSION = b"WARC/1.1"
MARK = b"WARC/1."       # opens a record of any version 1.x
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages have no date
PAGE = "Page-ID"               # extension field: the page's identifier
# end of fixed values

RECORD = T.StructType([T.StructField(n, t) for n, t in [
    ("record_id", T.StringType()), ("type", T.StringType()), ("page", T.StringType()), ("uri", T.StringType()),
    ("refers_to", T.StringType()), ("digest", T.StringType()), ("origin", T.StringType()), ("number", T.IntegerType()),
    ("total", T.LongType()), ("block", T.BinaryType()), ("status", T.StringType())]])


# -- writing ---------------------------------------------------------------------


def chunks(payload: bytes) -> bytes:
    """Chunked framing. A chunk ends within a version mark, so that no block holds one."""
    out, at = [], 0
    while at < len(payload):
        end = min(len(payload), at + CHUNK)
        hit = payload.find(MARK, at, min(len(payload), end + len(MARK) - 1))
        if hit >= 0:
            end = hit + 1
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def head(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", b""]) + block


def safe(value: str | None) -> str | None:
    """A header value: white space, controls and version marks are percent-encoded."""
    if value is None:
        return None
    out = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value)
    return out.replace(MARK.decode(), "WARC%2F1.")


def sha1_field(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(text: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(text.encode()).hexdigest()[:32])}>"


def records_of(page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, key: str, segment: int) -> Iterator[bytes]:
    """The record of one page, in segments if it is long."""
    rid = urn(key)
    common = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", safe(url)), (PAGE, safe(page))]
    if refers is not None:
        block = HTTP_HEAD  # a revisit keeps the headers only
        yield head([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers)),
                    ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = HTTP_HEAD + chunks(payload)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    more = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    yield head([("WARC-Type", "response"), *common, ("WARC-Payload-Digest", digest),
                ("Content-Type", "application/http;msgtype=response"), *more], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield head([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(f"{key}#{k}")), ("WARC-Date", DATE),
                    ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k)), *last], part)


def plan_records(pages: DataFrame, id_col: str, payload: str, least_shared: int) -> DataFrame:
    """pages plus __i (identifier text), __p (payload), __d (its SHA-256), __to
    (identifier of the response a revisit refers to) and __key, the name of
    the record: of the response it is the digest and identifier, which a
    revisit knows; of others it has a row number too."""
    p = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumn("__id", F.col(id_col)).withColumn("__p", p).withColumn("__d", F.sha2("__p", 256))
    shared = written(rows.where(F.length("__p") >= least_shared).groupBy(F.col("__d").alias("__g"))
                     .agg(F.max("__id").alias("__top"), F.count(F.lit(1)).alias("__n")).where("__n > 1"), "shared")
    rows = rows.join(maybe_broadcast(shared), F.col("__d") == F.col("__g"), "left").withColumn("__first", F.col("__id").eqNullSafe(F.col("__top")))
    # Rows that repeat payload and largest identifier: one is the response.
    ties = written(rows.where("__n IS NOT NULL AND __first").groupBy(F.col("__d").alias("__t")).count().where("count > 1").select("__t"), "ties")
    if not ties.isEmpty():
        tied = F.col("__first") & F.col("__n").isNotNull() & (F.col("__d") == F.col("__t"))
        some = rows.join(ties, tied, "left_semi").withColumn("__part", F.spark_partition_id())  # first one per task, then of those
        some = some.withColumn("__r", F.row_number().over(Window.partitionBy("__d", "__part").orderBy("__part")))
        rest = some.where("__r > 1").withColumn("__first", F.lit(False)).select(*rows.columns)
        one = some.where("__r = 1").withColumn("__first", F.row_number().over(Window.partitionBy("__d").orderBy("__part")) == 1).select(*rows.columns)
        rows = rows.join(ties, tied, "left_anti").unionByName(rest).unionByName(one)
    name = F.concat_ws("|", F.lit("response"), "__d", F.col("__top").cast("string"))
    is_shared = F.col("__n").isNotNull()
    return (rows.withColumn("__i", F.col("__id").cast("string")).withColumn("__to", F.when(is_shared & ~F.col("__first"), name))
            .withColumn("__key", F.when(is_shared & F.col("__first"), name).otherwise(
                F.concat_ws("|", F.lit("other"), "__d", F.monotonically_increasing_id().cast("string")))))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
               least_shared: int = LEAST_SHARED, segment: int = SEGMENT) -> None:
    """Write one record per row of ``pages`` to gzip archives under ``path``."""
    small_batches(pages.sparkSession)
    rows = plan_records(pages.select(pages[id_col].alias("__0"), pages[url].cast("string").alias("__1"), pages[payload].alias("__2")),
                        "__0", "__2", least_shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, uri, body, to, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += records_of(page, uri, body, sha1_field(body), to, key, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = rows.select("__i", "__1", "__p", "__to", "__key").mapInArrow(run, "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


# -- reading ---------------------------------------------------------------------


def parse(piece: bytes) -> tuple[dict[str, str] | None, bytes, int]:
    """Header fields (lower-case names), block and declared length of a record
    without its mark; None if it has no header or length."""
    top, found, block = piece.partition(b"\r\n\r\n")
    fields = {}
    for line in top.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon:
            fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not found or not length.isdecimal():
        return None, b"", 0
    return fields, block, int(length)


def record_row(piece: bytes) -> tuple:
    """One row of RECORD; the block is cut to its declared length."""
    f, block, n = parse(piece)
    if f is None:
        return (None,) * 10 + ("malformed",)
    short = len(block) < n
    num, total = (f.get(k, "") for k in ("warc-segment-number", "warc-segment-total-length"))
    return (f.get("warc-record-id"), f.get("warc-type"), f.get(PAGE.lower()), f.get("warc-target-uri"), f.get("warc-refers-to"),
            f.get("warc-payload-digest"), f.get("warc-segment-origin-id"), int(num) if num.isdecimal() else None,
            int(total) if total.isdecimal() else None, None if short else block[:n], "short" if short else None)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, as stored (RECORD)."""
    small_batches(spark)
    text = spark.read.option("lineSep", MARK.decode()).text(path)
    pieces = text.select(F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string")).alias("at"),
                         F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        schema = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string()))
                            for f in RECORD.fields])
        at, held, need = None, [], 0  # a record whose block goes on
        for batch in batches:
            out = []
            for where, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                piece = piece.as_py()
                if held and where == at:
                    held += [MARK, piece]
                    need -= len(MARK) + len(piece)
                else:
                    if held:
                        out.append(record_row(b"".join(held)))
                    held, need, at = [], 0, where
                    if not piece:
                        continue  # before a file's first mark
                    held = [piece]
                    _, block, n = parse(piece)
                    need = n - len(block)
                if need <= 0:
                    out.append(record_row(b"".join(held)))
                    held = []
            if out:
                yield table(out)
        if held:
            yield table([record_row(b"".join(held))])

    return pieces.mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records of one segment each: those of several are grouped by origin and
    joined in the order of their numbers; a broken one has no block and a status."""
    whole = records.where("number IS NULL")
    none = F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"))  # no identifier at all: a group of its own
    parts = (records.where("number IS NOT NULL").withColumn("__o", F.coalesce("origin", "record_id", none))
             .withColumn("__b", F.col("block").cast("string")))  # the same bytes, which can be compared in a set
    names = [c for c in records.columns if c not in ("origin", "number", "total", "block", "status")]
    first = F.col("number") == 1
    g = parts.groupBy("__o").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in names], F.max("total").alias("total"), F.max("status").alias("status"),
        F.sort_array(F.collect_set(F.struct("number", "__b"))).alias("s"))
    # Copies of a segment are one element of the set; equal numbers with different blocks fail the test of numbers.
    numbers = F.transform("s", lambda x: x["number"])
    complete = (F.size("s") > 0) & (numbers == F.sequence(F.lit(1), F.size("s")))
    block = F.array_join(F.transform("s", lambda x: x["__b"]), "").cast("binary")
    status = F.coalesce("status", F.when(~complete | F.col("total").isNull(), "segments missing").when(F.length(block) != F.col("total"), "length differs"))
    joined = g.select("__o", *names, F.when(status.isNull(), block).alias("block"), status.alias("status"))
    return whole.select(*names, "block", "status").unionByName(joined.withColumn("record_id", F.col("__o")).select(*names, "block", "status"))


def unchunk(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if it is broken."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        size = body[at:eol].split(b";")[0].strip() if eol >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), eol + 2
        if n == 0:
            return b"".join(out)  # trailer fields may follow
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def payload_of(block: bytes, http: bool) -> bytes | None:
    if not http:
        return block
    top, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    chunked = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower()
                  for k, _, v in (line.partition(b":") for line in top.split(b"\r\n")[1:]))
    return unchunk(body) if chunked else body


def digest_fits(digest: str | None, payload: bytes) -> bool:
    """Whether the payload has the declared SHA-1 (base 32 or hex); other algorithms are not checked."""
    if not digest or not digest.lower().startswith("sha1:"):
        return True
    own = hashlib.sha1(payload)
    return digest[5:] in (base64.b32encode(own.digest()).decode(), own.hexdigest())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record but continuations: record_id, type, page, uri, refers_to,
    digest, payload (decoded; null of revisits and broken records), status (null: sound)."""
    records = reassemble(read_records(spark, path))
    names = [c for c in records.columns if c not in ("block", "status")]
    schema = T.StructType([records.schema[c] for c in names] + [T.StructField("payload", T.BinaryType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, state = [], []
            for kind, digest, block, status in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "block", "status")), strict=True):
                payload = None
                if status is None and kind != "revisit":
                    payload = payload_of(block, kind == "response" and block.startswith(b"HTTP/"))
                    if payload is None:
                        status = "bad framing"
                    elif not digest_fits(digest, payload):
                        payload, status = None, "digest differs"
                out.append(payload)
                state.append(status)
            cols = [batch.column(c) for c in names] + [pa.array(out, pa.binary()), pa.array(state, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return records.select(*names, "block", "status").mapInArrow(run, schema)


def facts(records: DataFrame) -> DataFrame:
    """page, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to
    (the page of the response) and status of each response and revisit; a
    revisit has the facts of the full payload it refers to."""
    slim = written(records.where("type IN ('response', 'revisit')").select(
        "record_id", "type", "page", "refers_to", "status", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("h")), "warc-facts")
    revisits, responses = slim.where("type = 'revisit'"), slim.where("type = 'response'")
    wanted = written(responses.join(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
                     .select(F.col("record_id").alias("__id"), F.col("page").alias("__page"), F.col("n").alias("__n"), F.col("h").alias("__h"), F.col("status").alias("__s")), "referred")
    out = lambda n, h, to, status: [F.col("page"), n.alias("payload_bytes"), h.alias("payload_digest"), F.col("type").alias("record_type"),
                                    to.alias("refers_to"), status.alias("status")]
    found: Column = F.col("__id").isNotNull()
    seen = revisits.join(maybe_broadcast(wanted), F.col("refers_to") == F.col("__id"), "left")
    return responses.select(*out(F.col("n"), F.col("h"), F.lit(None).cast("string"), F.col("status"))).unionByName(
        seen.select(*out(F.col("__n"), F.col("__h"), F.col("__page"), F.coalesce("status", "__s", F.when(~found, "response missing")))))


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", **options) -> DataFrame:
    """Write the archives into the shared folder, read them back, and give the facts of every page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_warc(pages, path, id_col, url, payload, **options)
    return facts(read_warc(spark, path))
