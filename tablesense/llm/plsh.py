"""Near duplicates of vectors by Euclidean p-stable hashing (operator 6).

Vectors are normalised; for unit vectors cosine c means distance
sqrt(2 - 2 c). Each of L tables hashes a vector to K quantised random
projections floor((a.x + b) / W). K grows with the logarithm of the largest
label's size, so that few unrelated vectors meet in a bucket, and L is chosen
so that a pair just at the threshold meets in some table with probability
``RECALL``; pairs above it meet more surely. Candidates are checked by exact
cosine in double precision.

Identical vectors are one node with a weight. In a bucket every vector is first
compared with one pivot; vectors within half the threshold's angle of a common
centre form a ball, whose members are all linked with each other by the
triangle inequality and need no pairwise check. Then balls that share a bucket
are compared by their centres, and only balls near enough are compared member
by member. So a large group of near copies does not cost a check per pair. No
cap on buckets or candidates.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, or whose label is null, link with nothing; vectors of different
length are not compared; a null identifier links with nothing and has a null
component; rows that repeat an identifier count as vectors of their own but
share a class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import small_batches, written
from tablesense.llm.components import connected_components
from tablesense.llm.setjoin import U, mix

WIDTH = 2.0     # of a quantisation cell
RECALL = 0.97   # for a pair just at the threshold
MEET = 0.25     # unrelated vectors that a vector meets per table, about
SEED = 977
MARGIN = 1e-9   # against rounding of angles


def hit_rate(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors so far apart share a cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    k: int
    tables: int


def plan(cosine: float, largest: int) -> Tables:
    near, far = hit_rate(math.sqrt(2 - 2 * cosine)), hit_rate(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(largest, 2) / MEET) / -math.log(far)))
    return Tables(k, math.ceil(math.log(1 - RECALL) / math.log(1 - near ** k)))


def rows_of(col: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def by_length(*cols: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and matrices of the rows whose lists have one length."""
    size = np.diff(cols[0].offsets.to_numpy())
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, [rows_of(c.take(pa.array(at))) for c in cols]


def hash_table(nodes: DataFrame, t: Tables) -> DataFrame:
    """(key, node) of nodes (node, label, vec), one row per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, (x,) in by_length(batch.column(2)):
                d = x.shape[1]
                if d not in drawn:
                    rng = np.random.default_rng([SEED, d])
                    drawn[d] = rng.standard_normal((d, t.k * t.tables)), rng.uniform(0, WIDTH, t.k * t.tables)
                a, b = drawn[d]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(U).reshape(len(x), t.tables, t.k)
                key = mix(label[at].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + U(d))[:, None] + np.arange(t.tables, dtype=U)
                key = mix(key)
                for j in range(t.k):
                    key = mix(key + cell[:, :, j])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node[at], t.tables))], names=["key", "node"])
    return nodes.mapInArrow(run, "key long, node long")


def cosines(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, cos) of pairs (a, b, ...) of nodes with cosine >= least (a
    column ``least`` of the pairs, if there, instead)."""
    own = "least" in pairs.columns
    pairs = pairs.select("a", "b", F.col("least") if own else F.lit(least).alias("least"))
    both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "least", "va", "vb")
            .where("size(va) = size(vb)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = batch.column(2).to_numpy()
            cos = np.empty(batch.num_rows)
            for at, (x, y) in by_length(batch.column(3), batch.column(4)):
                cos[at] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            keep = pa.array(cos >= floor)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cos)], names=["a", "b", "cos"]).filter(keep)
    return both.mapInArrow(run, "a long, b long, cos double")


def near_vectors(vectors: DataFrame, cosine: float, id_col: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links (other rows linked directly),
    component_id (smallest identifier reachable), kept (vec_id = component_id)."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"),
                          F.col(label).cast("long").alias("label"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
             & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = written(rows.where("sound").groupBy("label", "vec").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w")).select("node", "label", "vec", "w"), "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    t = plan(cosine, largest)

    theta = math.acos(cosine)
    inner = math.cos(theta / 2 - MARGIN)
    keys = written(hash_table(nodes.select("node", "label", "vec"), t), "hashes")
    often = written(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
                    .select("key", "pivot"), "buckets")
    held = written(keys.join(often, "key"), "held")
    stars = held.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    core = written(cosines(stars, nodes, inner), "core")

    smaller = core.select(F.col("b").alias("s")).distinct()
    balls = written(core.join(smaller, core.a == smaller.s, "left_anti").groupBy("b").agg(F.min(F.struct("a", "cos")).alias("m"))
                    .select(F.col("b").alias("member"), F.col("m.a").alias("ball"), F.acos(F.least(F.col("m.cos"), F.lit(1.0))).alias("angle")), "balls")
    radius = written(balls.groupBy("ball").agg(F.max("angle").alias("r")), "radius")
    spots = written(held.join(balls, held.node == balls.member, "left").select("key", F.coalesce("ball", "node").alias("ball")).distinct(), "spots")
    mixed = spots.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    spots = written(spots.join(mixed, "key"), "mixed")
    a, b = spots.alias("a"), spots.alias("b")
    meet = (a.join(b, F.col("a.key") == F.col("b.key")).where("a.ball < b.ball")
            .select(F.col("a.ball").alias("a"), F.col("b.ball").alias("b")).distinct())
    reach = F.least(F.lit(theta + 2 * MARGIN) + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0)), F.lit(math.pi))
    meet = (meet.join(radius.select(F.col("ball").alias("a"), F.col("r").alias("ra")), "a", "left")
            .join(radius.select(F.col("ball").alias("b"), F.col("r").alias("rb")), "b", "left")
            .select("a", "b", F.cos(reach).alias("least")))
    close = written(cosines(meet, nodes, 0.0), "close")
    members = written(balls.select("ball", "member").unionByName(
        radius.select("ball", F.col("ball").alias("member"))), "members")
    out = (close.select(F.col("a").alias("ba"), F.col("b").alias("bb"))
           .join(members.select(F.col("ball").alias("ba"), F.col("member").alias("ma")), "ba", "left")
           .join(members.select(F.col("ball").alias("bb"), F.col("member").alias("mb")), "bb", "left")
           .select(F.coalesce("ma", "ba").alias("a"), F.coalesce("mb", "bb").alias("b")))
    links = written(cosines(out, nodes, cosine).select("a", "b"), "links")

    ties = links.unionByName(balls.select(F.col("ball").alias("a"), F.col("member").alias("b")))
    comp = connected_components(ties)
    weight = nodes.select(F.col("node").alias("id"), "w")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    direct = (ways.join(weight, ways.b == weight.id).groupBy("a").agg(F.sum("w").alias("direct")))
    mates = (members.join(weight, members.member == weight.id).groupBy("ball").agg(F.sum("w").alias("mates")))
    inside = members.join(mates, "ball").select(F.col("member").alias("m"), "mates")
    facts = written(nodes.select("node", "w").join(direct, F.col("node") == F.col("a"), "left")
                    .join(inside, F.col("node") == F.col("m"), "left").join(comp, F.col("node") == F.col("id"), "left")
                    .select("node", F.coalesce("component", "node").alias("component"),
                            (F.coalesce("mates", "w") - 1 + F.coalesce("direct", F.lit(0))).alias("n")), "facts")
    named = (rows.where("sound").join(nodes.select("label", "vec", "node"), ["label", "vec"])
             .join(facts, "node").select("vec_id", "n", "component"))
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    return named.unionByName(alone).select(
        "vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
