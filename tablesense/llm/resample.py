"""Target-distribution importance resampling (operator 12).

1. Words of a text (A-Z lower-cased) and runs of up to ``max_n`` of them are
   hashed into ``buckets``. One pass counts every bucket over all documents and
   one over all target texts: a task emits its non-empty buckets, so at most
   tasks x buckets rows are shuffled and ``buckets`` sums reach the driver.
2. A bucket's gain is the floored log ratio of its smoothed shares in target
   and documents. The array of gains (8 bytes a bucket) goes to the tasks, which
   score whole batches by array look-up: a document's weight is the floored mean
   gain of its features. A Gumbel term, made from a keyed hash of the
   identifier, is added, so the highest scores are a weighted sample without
   replacement. The narrow scored rows are written once.
3. The cutoff is found by a quantile sketch: two sketched quantiles around the
   wanted share bracket it; exact counts above and inside the bracket show
   whether it holds the cutoff, else it is widened. Only the bracket is sorted.
4. Drawn rows are ranked: dealt by ranges of (score, identifier, row), sorted
   within each range and written; a row's rank is its place in its range plus
   the rows of the ranges before it. No window and no join: undrawn rows are
   told by comparison with the cutoff row.

Scores spread by the Gumbel term and identical rows are told apart by a row
number, so neither copies nor one source gather in one range.

Defined results: a null text has no words; a document without features has
weight 0; a null identifier is hashed as the empty text and stands behind the
others among ties; repeated rows are scored and ranked each on its own, in any
order among themselves; documents under ``least_words`` words are not drawn (null rank);
an empty table gives an empty result, empty target texts give the smoothed
share; of extra columns those in ``keep`` are carried, columns named like the
results are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.llm.common import small_batches, written

ACCURACY = 1_000      # of the quantile sketch: its rank error is at most rows / ACCURACY
SLICE = 4_000_000     # bytes of a text cut into words at once
CACHE_WORDS = 500_000  # remembered buckets of one task
# Bytes to classes: A-Z become a-z; digits, a-z and bytes of characters beyond
# ASCII stay; all others become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Bucket of a feature's bytes, remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.n
        return b


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time."""
    data, at = data.translate(FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(data: bytes, known: Buckets, max_n: int) -> tuple[int, list[np.ndarray]]:
    """Number of words, and the buckets of all runs of 1 to ``max_n`` words."""
    count, out, carry = 0, [], []
    for ws in words(data):
        count += len(ws)
        out.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
        run = carry + ws
        for n in range(2, max_n + 1):
            # runs that end in this slice
            grams = [b" ".join(run[i - n:i]) for i in range(max(n, len(carry) + 1), len(run) + 1)]
            out.append(np.fromiter(map(known.__getitem__, grams), np.int64, len(grams)))
        carry = run[len(run) - (max_n - 1):] if max_n > 1 else []
    return count, out


def bucket_counts(texts: DataFrame, text: str, buckets: int, max_n: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for part in features(t.as_buffer().to_pybytes(), known, max_n)[1]:
                    sums += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    b, S, T_ = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + b) / ((s + 1.0) * (T_ + b)))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def score(docs: DataFrame, gain: np.ndarray, id_col: str, text: str, seed: int, max_n: int, keep: list[str]) -> DataFrame:
    """keep, id_col, __words, n_features, weight, score and __row, a row number, written."""
    small_batches(docs.sparkSession)
    names = [id_col, *[c for c in keep if c not in (id_col, "n_features", "weight", "score", "rank")]]
    kept = [docs.schema[c] for c in names]
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in ("__words", "n_features", "weight")])
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = Buckets(len(own))
        for batch in batches:
            n_words, n_feats, weights = [], [], []
            for t in batch.column(len(kept)):
                count, parts = features(t.as_buffer().to_pybytes(), known, max_n)
                n = sum(len(p) for p in parts)
                n_words.append(count)
                n_feats.append(n)
                weights.append(sum(int(own[p].sum()) for p in parts) // n if n else 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], *[pa.array(x, pa.int64()) for x in (n_words, n_feats, weights)]], names=schema.names)

    rows = docs.select(*[docs[c] for c in names], F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("__text"))
    out = rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    return written(out.withColumn("__row", F.monotonically_increasing_id()), "scored")


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df plus rank (1, 2, 3...) in the given total order."""
    own = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)  # the number's upper bits are the range, the lower ones the place in it
    sizes = {r["p"]: r["n"] for r in own.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    before, base = 0, []
    for p in sorted(sizes):
        base.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(base, "__p long, __base long")
    at = F.col("__at").bitwiseAND((1 << 33) - 1)
    return own.join(F.broadcast(offsets), part == F.col("__p")).withColumn("rank", F.col("__base") + at + 1).drop("__at", "__p", "__base")


def cutoff(rows: DataFrame, k: int, n: int, order: list[Column], accuracy: int = ACCURACY):
    """The k-th of ``n`` rows in the given order (descending score first)."""
    eps = 2.0 / accuracy
    while True:
        want = 1 - k / n
        qs = [max(0.0, want - eps), min(1.0, want + eps)]
        low, high = rows.agg(F.percentile_approx("score", qs, accuracy)).first()[0]
        if qs[0] == 0.0:  # no row lies below
            low = None
        if qs[1] == 1.0:
            high = None
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        c = rows.agg(F.count_if(over).alias("above"), F.count_if(~over & ~under).alias("inside")).first()
        if c["above"] < k <= c["above"] + c["inside"]:
            return ranked(rows.where(~over & ~under), order).where(F.col("rank") == k - c["above"]).first()
        eps *= 4


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024,
             buckets: int = 10_000, max_n: int = 1, id_col: str = "doc_id", text: str = "text",
             target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep``, id_col, n_features, weight, score, and
    rank among the drawn ones: the floor(percent / 100 * N) highest scores of
    the N documents with at least ``least_words`` words; else null."""
    gain = gains(bucket_counts(docs, text, buckets, max_n), bucket_counts(target, target_text, buckets, max_n))
    rows = score(docs, gain, id_col, text, seed, max_n, keep or [])
    able = F.col("__words") >= least_words
    n = rows.where(able).count()
    k = percent * n // 100
    out = [c for c in rows.columns if not c.startswith("__")]
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*out, none)
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("__row").asc()]
    last = cutoff(rows.where(able), k, n, order)
    i = F.col(id_col)
    sooner = i.isNotNull() if last[id_col] is None else F.coalesce(i < last[id_col], F.lit(False))  # nulls stand last
    same = i.eqNullSafe(F.lit(last[id_col])) & (F.col("__row") <= last["__row"])
    first = (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (sooner | same))
    drawn = able & first
    return rows.where(~drawn).select(*out, none).unionByName(ranked(rows.where(drawn), order).select(*out, "rank"))
