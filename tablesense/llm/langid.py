"""Language identification (operator 5): multinomial naive Bayes over hashed
character n-grams.

Training counts n-grams of all labelled rows: every task sums its texts into one
count table per language, and one grouping adds the tables up. The model is a
matrix languages x ``BUCKETS`` of log probabilities (its size does not depend on
the corpus); it is broadcast, and batches are scored in numpy from their sparse
counts. The language is the argmax of the plain sums, whatever the text's length.
Its score is the posterior, cooled for texts of more than ``EVIDENCE`` n-grams:
logarithms, prior included, are divided by n / ``EVIDENCE``, so that long texts do
not all score 1; this keeps the order of the languages.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text if no row is labelled; ties go to the least language by code
point; a null language is no label; an empty table gives an empty result;
repeated rows count and are scored each; extra columns are kept, columns named
like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.llm.common import small_batches

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
ALPHA = 0.5         # added to every count
EVIDENCE = 60.0     # n-grams above which a score is cooled, so that scores grade
CHUNK = 1 << 19     # characters worked on at once
MOST_LANGUAGES = 1000  # languages whose counts a task holds before it passes them on


def grams(low: list[str], own: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of lower-cased texts that begins in the
    first ``own`` characters of its text."""
    size = np.array([len(t) for t in low], dtype=np.int64)
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(low)), size)
    mine = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(size if own is None else np.array(own, dtype=np.int64), size)
    rows, buckets = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ c[j:j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = mine[:m] & (row[:m] == row[n - 1:])
        rows.append(row[:m][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of the texts, about ``CHUNK`` characters at
    a time. A longer text comes in pieces that overlap by less than an n-gram."""
    part, own, at, n = [], [], [], 0
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for lo in range(0, len(low), CHUNK):
            part.append(low[lo:lo + CHUNK + max(ORDERS) - 1])
            own.append(CHUNK)
            at.append(i)
            n += len(part[-1])
            if n >= CHUNK:
                row, bucket = grams(part, own)
                yield np.array(at)[row], bucket
                part, own, at, n = [], [], [], 0
    if part:
        row, bucket = grams(part, own)
        yield np.array(at)[row], bucket


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray   # log probabilities
    matrix: np.ndarray  # BUCKETS x languages

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of every text and its probability, graded."""
        total = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for row, bucket in counted(texts):
            cells = np.sort(row * BUCKETS + bucket)
            start = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            at, count = cells[start], np.diff(np.append(start, len(cells)))  # the sparse counts, by row
            owner = at // BUCKETS
            value = count[:, None] * self.matrix[at % BUCKETS]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[first]] += np.add.reduceat(value, first, axis=0)
            n[owner[first]] += np.add.reduceat(count, first)
        total += self.prior
        top = total.argmax(axis=1)
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        graded = np.exp((total - total.max(axis=1, keepdims=True)) / np.maximum(1.0, n / EVIDENCE)[:, None])
        return ([self.languages[x] if k else "und" for x, k in zip(top, known, strict=True)],
                np.where(known, 1 / graded.sum(axis=1), 0.0))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with a language. What comes to the driver is the
    model itself: languages x BUCKETS counts."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def out(counts: dict[str, np.ndarray], seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for x, c in counts.items():
            at = np.append(np.flatnonzero(c), BUCKETS)  # the last: texts
            n = np.append(c[at[:-1]], seen[x])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(t)
            for x, texts in by.items():
                if x not in counts and len(counts) >= MOST_LANGUAGES:
                    yield from out(counts, seen)
                    counts, seen = {}, {}
                seen[x] = seen.get(x, 0) + len(texts)
                c = counts.setdefault(x, np.zeros(BUCKETS, dtype=np.int64))
                for _, bucket in counted(texts):
                    c += np.bincount(bucket, minlength=BUCKETS)
        yield from out(counts, seen)

    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    at = np.searchsorted(np.array(langs, dtype=object), np.array(sums.column("lang").to_pylist(), dtype=object)) if langs else np.empty(0, int)
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[at.astype(int), sums.column("bucket").to_numpy().astype(int)] = sums.column("n").to_numpy()
    grid = counts[:, :BUCKETS] + ALPHA
    prior = np.log(np.maximum(counts[:, BUCKETS], 1) / max(counts[:, BUCKETS].sum(), 1))
    return Model(langs, prior, np.ascontiguousarray(np.log(grid / grid.sum(axis=1, keepdims=True)).T))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to ``docs`` (its columns in ``keep``)."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score") and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            if shared.value.languages:
                best, score = shared.value.scores(texts)
            else:
                best, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(best, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*[docs[f.name] for f in kept], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)
