"""Toxicity by a factorization machine over hashed terms (operator 4).

Terms are words and their beginnings (4 and 6 bytes), hashed to ``1 << BITS``
buckets. From a bounded sample of labelled rows (``MOST_TRAIN`` rows, half of
each class at most) one task picks the ``FEATURES`` buckets that tell the
classes apart best (chi-square) and fits

    f(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

by AdaGrad: the factors v learn pairs of terms that additive weights miss.
Both classes weigh the same, so a score is the probability among as many toxic
as other rows, not among the rarer toxic rows of the corpus. The model is broadcast (FEATURES x (RANK + 1) numbers); every
whole text is scored in numpy.

Defined results: a text without terms (null, empty, signs only) scores the
intercept; if no row is labelled, or only one class, the score is the share of
toxic rows (0 without any); several labels of a document count as toxic if one
is; null labels are none; repeated rows are scored each; an empty table gives
an empty result; extra columns are kept, columns named like the results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.llm.common import maybe_broadcast, small_batches, written

BITS = 20
MOST_TRAIN = 12_000
FEATURES = 4096
RANK = 8
EPOCHS = 15
BATCH = 128
RATE = 0.1
DECAY = 1e-5
LEAST_ROWS = 5  # rows of the sample that hold a term, for it to be picked
BEGINNINGS = (4, 6)
SEED = 5

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(99))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BYTE[_GAP] = 0
_POWER = np.cumprod(np.concatenate([np.ones(1, dtype=U), np.full(63, _rng.integers(1, 2**64 - 1, dtype=U) | U(1), dtype=U)]), dtype=U)


def terms(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's terms: words (runs of letters and digits,
    every non-ASCII byte taken as a letter) and beginnings of longer ones."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    gap = _GAP[b]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(b) else np.empty(0, int)
    if not len(start):
        return np.empty(0, dtype=np.int64)
    b, first = b[start[0]:], start[0]
    start = start - first
    size = np.diff(np.append(start, len(b)))
    off = np.arange(len(b)) - np.repeat(start, size)
    v = _BYTE[b] * _POWER[off % 64] + (off // 64).astype(U) * _BYTE[b]
    length = np.add.reduceat((~gap[first:]).astype(np.int64), start)
    out = [np.add.reduceat(v, start)]
    for n in BEGINNINGS:
        h = np.add.reduceat(np.where(off < n, v, U(0)), start)[length > n]
        out.append(h * U(0x9E3779B97F4A7C15) + U(n))
    h = np.concatenate(out)
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return np.unique(h >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    place: np.ndarray   # bucket -> feature, or -1
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, text: str | None) -> float:
        x = self.place[terms(text)]
        x = x[x >= 0]
        v = self.v[x]
        s = v.sum(axis=0)
        f = self.w0 + self.w[x].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(f, -500, 500))))


def pick(y: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The buckets of highest chi-square against the label."""
    at = np.concatenate(rows)
    n = np.bincount(at, minlength=1 << BITS).astype(float)
    k = np.bincount(at, weights=np.repeat(y, [len(r) for r in rows]), minlength=1 << BITS)
    share = y.mean()
    chi = np.where(n >= LEAST_ROWS, (k - n * share) ** 2 / np.maximum(n * share * (1 - share) * (1 - n / (len(y) + 1)), 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] > 6.6])  # one in a hundred by chance


def fit(y: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(features, w0, w, v) from labels and distinct buckets per row."""
    features = pick(y, rows)
    place = np.full(1 << BITS, -1)
    place[features] = np.arange(len(features))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(SEED)
    w0, w, v = 0.0, np.zeros(len(features)), rng.normal(0, 0.01, (len(features), RANK))
    g0, gw, gv = 1e-8, np.full(len(features), 1e-8), np.full((len(features), RANK), 1e-8)
    for _ in range(EPOCHS if len(features) else 0):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            part = order[lo:lo + BATCH]
            size = np.array([len(rows[i]) for i in part])
            x = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), size)
            vx = v[x]
            s = np.zeros((len(part), RANK))
            np.add.at(s, owner, vx)
            q = np.bincount(owner, weights=(vx * vx).sum(axis=1), minlength=len(part))
            f = w0 + np.bincount(owner, weights=w[x], minlength=len(part)) + 0.5 * ((s * s).sum(axis=1) - q)
            d = weight[part] * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[part]) / len(part)
            dx = d[owner]
            step = d.sum()
            g0 += step * step
            w0 -= RATE * step / np.sqrt(g0)
            used, inv = np.unique(x, return_inverse=True)
            dw = np.bincount(inv, weights=dx, minlength=len(used)) + DECAY * w[used]
            gw[used] += dw * dw
            w[used] -= RATE * dw / np.sqrt(gw[used])
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, inv, dx[:, None] * (s[owner] - vx))
            dv += DECAY * v[used]
            gv[used] += dv * dv
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return features, w0, w, v


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MOST_TRAIN) -> Model:
    """``labels`` (id, toxic 0/1). The sample is drawn by a hash of the id, about
    ``most`` rows at most, and meets in one task."""
    spark = docs.sparkSession
    small_batches(spark)
    lab = written(labels.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("y")), "labels")
    found = lab.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    n = dict(found.groupBy("y").count().collect())  # two rows
    bad, good = n.get(1, 0), n.get(0, 0)
    none = np.full(1 << BITS, -1)
    share = bad / (bad + good) if bad + good else 0.0
    if not bad or not good:
        return Model(none, 500.0 if share else -500.0, np.zeros(0), np.zeros((0, RANK)))
    half = most / 2
    rate = F.when(F.col("y") == 1, min(1.0, half / bad)).otherwise(min(1.0, half / good))
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 24)) / float(1 << 24)
    ids = written(lab.where(draw < rate), "sample")
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(maybe_broadcast(ids), "id")
            .select("id", "y", "text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [terms(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not got:
            return
        got.sort(key=lambda r: (r[0], r[1], r[2]))  # the same order in every run
        out = fit(np.array([r[1] for r in got], dtype=float), [np.frombuffer(r[2], dtype=np.int32).astype(np.int64) for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes()], pa.binary()) for x in out], names=["f", "w0", "w", "v"])

    sample = written(rows.mapInArrow(hashed, "id long, y int, x binary"), "terms")
    one = written(sample.repartition(1).mapInArrow(learn, "f binary, w0 binary, w binary, v binary"), "model").first()
    f, w0, w, v = (np.frombuffer(x, dtype=np.float64) for x in one)
    none[f.astype(np.int64)] = np.arange(len(f))
    return Model(none, float(w0[0]), w, v.reshape(-1, RANK))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score to ``docs`` (its columns in ``keep``)."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "score" and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.score(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(got, pa.float64())], names=schema.names)

    return docs.select(*[docs[f.name] for f in kept], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


def toxic(score_col: Column, threshold: float = 0.7) -> Column:
    return (score_col >= threshold).cast("int")
