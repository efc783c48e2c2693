"""Connected components of a link table, by alternating large-star and
small-star steps: every step is a partial-aggregated minimum per node and a
join, written to the shared folder, so lineage stays short and a hub with many
links is split by the join. Ends when a round leaves the edges as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import maybe_broadcast, written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return maybe_broadcast(written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): one row per node that has a link to another node:
    id, component (the smallest id reachable). Nulls and self links are
    ignored."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    now = _signature(edges)
    while now != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _signature(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
