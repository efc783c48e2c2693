"""Mixing sources to target weights by balanced sampling with the cube method
(operator 7).

Sizes are word counts. Sources share a budget of words by weight; a source's
target stops at ``most`` times its size and the excess is shared again. In a
source every document is taken floor(target / size of source) times, and once
more with the probability of the rest. Which documents get the extra copy is
drawn by the cube method: the flight phase moves the vector of inclusion
probabilities along directions of the null space of the balancing constraints
(words, documents) until each but a few are 0 or 1; the landing phase drops the
constraint on documents, then rounds the last one.

A source is cut into blocks by a hash of the identifier; the flight runs in
every block on its own and leaves two undecided documents and the ``SPARE``
smallest ones, which meet in blocks of the next level, until one block per source
is left. So no task holds
more than about ``BLOCK`` documents, whatever a source's share. Random numbers
are seeded by source and block, and block members are ordered by a hash, so
reruns and other partitionings give the same sample.

Defined results: a null or blank text has size 0; a null source comes last and
is a source of its own; a source without words has target 0 and takes nothing;
rows alike in identifier, source and size are drawn together, those without
identifier too; an empty table gives an empty result; extra columns are kept,
columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.common import BROADCAST_NAMES, maybe_broadcast, narrow, small_batches, word_count, written

BLOCK = 512       # documents of one flight, about
SPARE = 32        # the smallest documents of a block, left open to the next level
EPS = 1e-12


def move(pi: np.ndarray, at, u: np.ndarray, draw: float) -> None:
    """Move pi[at] along u or -u until an entry is 0 or 1, so that the expected
    move is zero; ``draw`` is uniform on [0, 1)."""
    p, u = pi[at], np.asarray(u, dtype=float)
    room = np.where(u > 0, 1 - p, p), np.where(u > 0, p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (np.where(u != 0, r / np.abs(u), np.inf).min() for r in room)
    p = p + (up if draw * (up + down) < down else -down) * u
    pi[at] = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase, three entries at a time: move pi until at most two lie
    strictly between 0 and 1, keeping the sums of pi and of pi * size."""
    p, s = pi.tolist(), size.astype(float).tolist()
    draws = rng.random(len(p) + 1).tolist()  # every step settles an entry
    live: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) > 2:
            a, b, c = (s[j] for j in live)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = min(((1 - p[j]) if x > 0 else p[j]) / abs(x) for j, x in zip(live, u, strict=True) if x)
            down = min((p[j] if x > 0 else (1 - p[j])) / abs(x) for j, x in zip(live, u, strict=True) if x)
            step = up if draws.pop() * (up + down) < down else -down
            for j, x in zip(live, u, strict=True):
                v = p[j] + step * x
                p[j] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            live = [j for j in live if 0 < p[j] < 1]
    return np.array(p)


def settle(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight and landing of the last block of a source: entries are decided
    from the largest size on, each against all smaller ones that are open, which
    move by the least amount that keeps both sums; so only the smallest are left
    to land. There the sum of pi is given up, then the last entry rounded."""
    pi, size = pi.astype(float), size.astype(float)
    pi[pi < EPS], pi[pi > 1 - EPS] = 0.0, 1.0
    order = np.argsort(-size, kind="stable")
    for n, i in enumerate(order):
        while 0 < pi[i] < 1:
            rest = order[n + 1:]
            rest = rest[(pi[rest] > 0) & (pi[rest] < 1)]
            w = pi[rest] * (1 - pi[rest])
            a = np.vstack([size[rest], np.ones(len(rest))])
            gram = (a * w) @ a.T
            if len(rest) and np.linalg.det(gram) > 1e-9 * gram[0, 0] * gram[1, 1]:
                u = w * (np.linalg.solve(gram, [-size[i], -1.0]) @ a)
            elif gram[0, 0] > 0:
                u = w * a[0] * (-size[i] / gram[0, 0])
            else:  # none open, or only empty texts
                rest, u = rest[:0], np.empty(0)
            move(pi, np.append(i, rest), np.append(1.0, u), rng.random())
    return pi


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, n (rows), source_size, target: one row per source. Sources are numbered by
    code point, null last; ``sized`` has source and size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = written(narrow(totals), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    state = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full", F.lit(False))
    state = written(state, "shares")
    budget = share * float(state.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # each round fills a source at least, or is the last
        used, open_w = state.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)),
                                 F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0))).first()
        level = (budget - (used or 0.0)) / open_w if open_w else 0.0
        got = F.col("w") * F.lit(level)
        over = ~F.col("full") & (got > F.col("cap"))
        if not open_w or not state.where(over).limit(1).count():
            return state.select("source", "n", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(got).cast("double").alias("target"))
        state = written(state.withColumn("full", F.col("full") | over), "shares")


def _fly(units: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """One flight per (source, block): units with their new pi. ``n``, the most
    units of a source at this level, gives its number of blocks."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        rng = np.random.default_rng(_seed(seed, level, *[None if pd.isna(k) else str(k) for k in key]))
        pi, size = pdf["pi"].to_numpy().copy(), pdf["size"].to_numpy()
        if last:
            pi = settle(pi, size, rng)
        else:
            fly = np.ones(len(pi), dtype=bool)
            fly[np.argsort(size, kind="stable")[:SPARE]] = False
            pi[fly] = flight(pi[fly], size[fly], rng)
        pdf["pi"] = pi
        return pdf[["h", "source", "size", "n", "pi"]]

    cut = units.withColumn("block", F.expr(f"pmod(xxhash64(h, {level}), CAST(ceil(n / {BLOCK}) AS BIGINT))"))
    done = cut.groupBy("source", "block").applyInPandas(run, "h long, source string, size long, n long, pi double")
    return done.withColumn("n", F.expr(f"CAST({2 + SPARE} * ceil(n / {BLOCK}) AS BIGINT)"))  # left open per block


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: its columns (one named like a result is
    replaced) and size, source_size, target (the source's), copies, taken
    (size * copies)."""
    small_batches(docs.sparkSession, 10_000)
    named = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*[c for c in named if c not in (id_col, text, source)])
    src = F.col(source).cast("string")
    rows = docs.withColumn("size", word_count(F.col(text).cast("string")))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), src, F.col("size")))
    slim = written(narrow(rows.groupBy(F.col("__h").alias("h"), src.alias("source")).agg(F.sum("size").alias("size"))), "sizes")
    targets = written(source_targets(slim.select("source", "size"), tuple(weights), share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = maybe_broadcast(targets.select(F.col("source").alias("s"), "n", rate.alias("rate")), limit=BROADCAST_NAMES)
    units = slim.join(rates, slim.source.eqNullSafe(F.col("s"))).select(
        "h", "source", "size", "n", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("pi"))

    now, decided, level = units.select("h", "source", "size", "n", "pi").where("pi > 0"), [], 0
    n = targets.agg(F.max("n")).first()[0] or 0
    while True:
        last = n <= BLOCK
        now = written(narrow(_fly(now, seed, level, last)), f"flight{level}")
        decided.append(now.where("pi = 1").select(F.col("h").alias("eh"), F.col("source").alias("es")))
        if last:
            break
        now, n, level = now.where("pi > 0 AND pi < 1"), (2 + SPARE) * math.ceil(n / BLOCK), level + 1
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.unionByName(d)
    extra = extra.withColumn("extra", F.lit(1))
    chosen = units.join(extra, (F.col("h") == F.col("eh")) & F.col("source").eqNullSafe(F.col("es")), "left").select(
        F.col("h").alias("__ch"), F.col("source").alias("__cs"), (F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies"))
    facts = maybe_broadcast(targets.select(F.col("source").alias("__s"), "source_size", "target"), limit=BROADCAST_NAMES)
    got = (rows.join(chosen, (F.col("__h") == F.col("__ch")) & src.eqNullSafe(F.col("__cs")))
           .join(facts, src.eqNullSafe(F.col("__s"))))
    return got.select(*[rows[c] for c in docs.columns if c not in named or c in (id_col, text, source)], F.col("size"),
                      F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"),
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"))
