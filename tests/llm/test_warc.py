import gzip
import hashlib
import os
import random

import pytest

from tablesense.llm import warc as W
from tablesense.session import scratch_path

BIG = "<p>" + "page ü text " * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/x", BIG), (2, "http://a/ö y\r\nWARC-Type: x", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "", "short"), (7, "u", "short"),
            (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60), (9, "WARC/1.0", "WARC/1.0"), (None, "u", BIG), (None, None, "x" * 1000),
            (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000), (13, "v", "y" * 1000), (14, "u", "z" * 300_000),
            (15, "u", "ünïcode 🙂" * 5000), (15, "u", "ünïcode 🙂" * 5000)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, record_id string, __p string")


def brute(rows, least=1000):
    groups = {}
    for r in rows:
        groups.setdefault(r.html or "", []).append(r.page_id)
    out, seen = [], set()
    for r in rows:
        body = (r.html or "").encode()
        top = max((i for i in groups[r.html or ""] if i is not None), default=None)
        shared = len(body) >= least and len(groups[r.html or ""]) > 1
        first = not shared or (r.page_id == top and (r.html or "") not in seen)
        if shared and first:
            seen.add(r.html or "")
        out.append((r.page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if first else "revisit", None if first else top, None))
    return sorted(out, key=repr)


def result(df):
    return sorted(((int(r.page) if r.page is not None else None, r.payload_bytes, r.payload_digest, r.record_type,
                    int(r.refers_to) if r.refers_to is not None else None, r.status) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment", [97, W.SEGMENT])
def test_round_trip(pages, segment):
    assert result(W.round_trip(pages.repartition(3), segment=segment)) == brute(pages.collect())


def test_payloads_and_fields_come_back(spark, pages):
    path = scratch_path(spark, "warc-test")
    W.write_warc(pages.where("page_id NOT IN (1, 2, 13)"), path, segment=500)
    stored = W.read_records(spark, path)
    assert stored.where("type = 'continuation'").count() > 600 and stored.where("status IS NOT NULL").count() == 0
    got = {r.page: r for r in W.read_warc(spark, path).collect()}
    for r in pages.where("page_id NOT IN (1, 2, 13, 15)").collect():
        if r.page_id is not None:
            assert got[str(r.page_id)].payload.decode() == (r.html or "")
    assert got["9"].uri == "WARC%2F1.0" and got["3"].uri is None


def test_empty_table(spark, pages):
    assert W.round_trip(pages.limit(0)).count() == 0


def record(kind, rid, block, length=None, **fields):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}"] + [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    return b"WARC/1.0\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block) if length is None else length}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n"


def test_foreign_archives(spark):
    """Segments out of order and over several files, repeated, missing, wrong
    lengths, chunk extensions and trailers, records inside records."""
    body = b"5;name=v\r\nhello\r\n6 \r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    block = HTTP + body
    cut = [block[:20], block[20:41], block[41:]]
    seg = lambda o, k, b, **f: record("continuation", f"{o}.{k}", b, WARC_Segment_Origin_ID=o, WARC_Segment_Number=k, **f)
    inner = record("response", "inner", b"HTTP/1.1 200 OK\r\n\r\nno")
    recs = [
        record("response", "a", cut[0], WARC_Segment_Number=1), seg("a", 2, cut[1]), seg("a", 2, cut[1]), seg("a", 3, cut[2], WARC_Segment_Total_Length=len(block)),
        record("response", "b", cut[0], WARC_Segment_Number=1), seg("b", 3, cut[2], WARC_Segment_Total_Length=len(block)),
        record("response", "c", cut[0], WARC_Segment_Number=1), seg("c", 2, cut[1], WARC_Segment_Total_Length=len(block)),
        record("response", "d", cut[0], WARC_Segment_Number=1), seg("d", 2, cut[1]),
        record("response", "e", HTTP + b"zz\r\n"), record("response", "f", b"HTTP/1.1 200 OK\r\n\r\nplain"),
        record("resource", "g", b"just bytes \xff\xfe", WARC_Payload_Digest="sha1:" + hashlib.sha1(b"just bytes \xff\xfe").hexdigest()),
        record("resource", "h", b"other", WARC_Payload_Digest="sha1:AAAA"), record("resource", "i", inner + inner), record("warcinfo", "j", b"software: x"),
        b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n", record("revisit", "k", b"", WARC_Refers_To="nowhere", Page_ID="9"), b"WARC/1.0\r\n" + b"WARC-Segment-Number: 2\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    ]
    path = scratch_path(spark, "warc-foreign")
    os.makedirs(path)
    random.Random(3).shuffle(recs)
    for i in range(3):  # one gzip member a record, as archives have
        with open(f"{path}/{i}.warc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(r) for r in recs[i::3]))
    with open(f"{path}/cut.warc", "wb") as f:
        f.write(record("resource", "l", b"x" * 10) + record("resource", "m", b"cut", length=50))
    got = {r.record_id: (r.status, bytes(r.payload) if r.payload is not None else None) for r in W.read_warc(spark, path).collect()}
    assert got["a"] == (None, b"hello world") and got["f"] == (None, b"plain") and got["g"] == (None, b"just bytes \xff\xfe")
    assert got["b"][0] == got["d"][0] == "segments missing" and got["c"][0] == "length differs" and got["e"][0] == "bad framing"
    assert got["h"][0] == "digest differs" and got["i"] == (None, inner + inner) and got["j"] == (None, b"software: x")
    assert got[None][0] == "malformed" and got["l"] == (None, b"x" * 10) and got["m"] == ("short", None) and "inner" not in got
    assert sum(s == "segments missing" for s, _ in got.values()) == 3
    lost = W.facts(W.read_warc(spark, path)).where("page = '9'").collect()
    assert [(r.record_type, r.status, r.payload_bytes) for r in lost] == [("revisit", "response missing", None)]


def test_records_pass_task_borders(spark, pages):
    """Uncompressed archives are split; own blocks never hold the mark."""
    path = scratch_path(spark, "warc-split")
    W.write_warc(pages.where("page_id > 7"), path, segment=10_000)
    plain = scratch_path(spark, "warc-plain")
    spark.read.option("lineSep", "\0").text(path).coalesce(1).write.option("lineSep", "\r\n").text(plain)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "20000")
    try:
        got = W.read_warc(spark, plain)
        assert W.read_records(spark, plain).rdd.getNumPartitions() > 5
        rows = [r for r in got.collect() if r.type == "response"]
    finally:
        spark.conf.set(key, before)
    want = {r.page_id: r.html for r in pages.where("page_id > 7").collect()}
    assert len(rows) == 7 and all(r.status is None and r.payload.decode() == want[int(r.page)] for r in rows)
