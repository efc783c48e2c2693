import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablesense.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text, max_n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return ws, [" ".join(ws[i:i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, percent, least, max_n=1, buckets=10_000, seed=2024):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, sums in ((docs, s), (target, t)):
        for x in texts:
            for f in feats(x[-1], max_n)[1]:
                sums[b(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (S + buckets) / ((x + 1) * (T + buckets)))) for x, y in zip(s, t, strict=True)]
    rows, able = [], []
    for i, text in docs:
        ws, fs = feats(text, max_n)
        w = sum(gain[b(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        r = [i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        rows.append(r)
        if len(ws) >= least:
            able.append(r)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r) for r in rows), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent,max_n", [(10, 1), (60, 2), (100, 3), (0, 1)])
def test_equals_brute_force(spark, clash, monkeypatch, percent, max_n):
    monkeypatch.setattr(R, "SLICE", 1000)  # long texts cross slices
    target = [("Quick brown FOX",), (None,), ("über den hund, 's wide",)]
    docs = clash.withColumn("weight", F.lit("clash")).withColumn("__text", F.lit("clash"))
    got = R.resample(docs, spark.createDataFrame(target, "text string"), percent, 3, max_n=max_n)
    assert result(got) == brute([(r.doc_id, r.text) for r in clash.collect()], target, percent, 3, max_n)


def test_many_ties_and_repeated_rows(spark):
    rows = [(i % 7, "same words in all of these") for i in range(300)] + [(None, "same words in all of these")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = R.resample(df, spark.createDataFrame([("words",)], "text string"), 50, 2)
    assert result(got) == brute(rows, [("words",)], 50, 2)


def test_a_bad_sketch_is_widened(spark):
    rows = spark.range(5000).select((F.col("id") * F.col("id") % 977).alias("score"), F.col("id").alias("doc_id"), F.lit(0).alias("__row"))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    want = sorted(((r.score, r.doc_id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    for k in (1, 17, 2500, 4999, 5000):
        for accuracy in (2, 100):  # the coarse sketch misses
            last = R.cutoff(rows, k, 5000, order, accuracy)
            assert (last.score, last.doc_id) == want[k - 1]


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert R.resample(none, none).count() == 0
    assert R.resample(documents, none, 50, 1).where("rank IS NOT NULL").count() == sum(
        len(feats(r.text, 1)[0]) >= 1 for r in documents.collect()) // 2


def test_keep_carries_columns(spark, documents):
    got = R.resample(documents, documents, keep=["lang", "source"])
    assert got.columns == ["doc_id", "lang", "source", "n_features", "weight", "score", "rank"] and got.count() == documents.count()
