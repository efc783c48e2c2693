"""Reproducible sampling (W6) and bounded head.

Both are ``orderBy(..).limit(n)``, which Spark plans as
TakeOrderedAndProject: every task keeps at most n rows and only those are
merged, never a full sort. The sample filters by hash first, so that about n
rows in all are kept by the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_key(keys: list[str], seed: int = 42) -> Column:
    """md5 of 'seed:k1:k2..' — the same text DuckDB hashes for the oracle."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *parts)))


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the smallest seeded key hash (bottom-k sample).

    Rows whose hash lies above the share that surely holds n rows are filtered
    out first, so few rows of each task meet at the end. If that share held
    fewer than n rows after all, the filter is left out: the result is the same."""
    key = sample_key(keys, seed)
    total = df.count()
    share = (n + 10 * n ** 0.5 + 100) / max(total, 1)
    if share < 1:
        low = df.where(F.substring(key, 1, 8) < f"{int(share * 16 ** 8):08x}")
        if low.count() >= n:
            df = low
    return df.orderBy(key, *keys).limit(n)


def bounded_head(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows by key (a deterministic head)."""
    return df.orderBy(*keys).limit(n)
