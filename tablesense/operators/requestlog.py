"""Request-log summaries (A22-A26) over a table of requests.

A log is any DataFrame with a time column, a success flag, a response time
(seconds) and an error message. Every summary is a grouped aggregation with
partial aggregation map-side. Exact percentiles are found by selection in passes:
a sketch of what lies in the bracket narrows it, exact counts confirm it, until
few values are left; only those are ranked. A request whose flag is null counts
as a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.session import materialize

# ---------------------------------------------------------------------------
# Thresholds of the reference's load-test verdicts and bands.
# ---------------------------------------------------------------------------
SUCCESS_TARGET = 0.95
STABLE_SHARE = 0.9
SLOW_MEAN_SEC = 5.0
GOOD_MEAN_SEC = 2.0
MIN_RPS = 1.0
BAND_FAST_MS, BAND_OK_MS = 1000, 3000
ERROR_TEXT_CHARS = 100
P95 = 0.95
# end of fixed values


def _span_seconds(ts: Column) -> Column:
    return (F.max(ts).cast("timestamp").cast("double") - F.min(ts).cast("timestamp").cast("double"))


def latency_summary(log: DataFrame, group: list[str], ts: str, ok: Column, rt: str, confidence: Column | None = None) -> DataFrame:
    """A22 per group: totals, success and error shares, requests per second
    over the group's time span, mean/min/max and exact 95th percentile (exclusive
    method) of the response times of successes, and their mean confidence (null
    if the log has none)."""
    ok = F.coalesce(ok, F.lit(False))
    succ_rt = F.when(ok, F.col(rt))
    p95 = p95_exclusive(log.where(ok), rt, group)
    same = [F.col(f"s.{g}").eqNullSafe(F.col(f"p.{g}")) for g in group]
    mean_confidence = F.lit(None).cast("double") if confidence is None else F.avg(F.when(ok, confidence))
    summary = log.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successes"),
        (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("success_pct"),
        (F.count_if(~ok) * 100.0 / F.count(F.lit(1))).alias("error_pct"),
        F.try_divide(F.count(F.lit(1)).cast("double"), _span_seconds(F.col(ts))).alias("rps"),  # null for one instant
        F.avg(succ_rt).alias("mean_rt"),
        F.min(succ_rt).alias("min_rt"),
        F.max(succ_rt).alias("max_rt"),
        mean_confidence.alias("mean_confidence"),
    )
    return summary.alias("s").join(p95.alias("p"), same, "left").select("s.*", F.col("p.p95").alias("p95_rt"))


ACCURACY = 10000  # percentile_approx is off by at most 1 / ACCURACY of the rows
GRID = 1000       # quantiles of a sketch; a pass keeps about 5 of its intervals
RANKED = 100_000  # so many values of a group are ranked by one task


def order_statistics(values: DataFrame, col: str, group: list[str], rank, ranked: int = RANKED) -> DataFrame:
    """Per group: n, lo and hi, the values at ranks floor(r) and floor(r) + 1
    (from 1, within 1..n), where r = rank(n) is an expression of the count.

    A group's bracket [a, b] (null: open) holds both ranks; ``below`` values are
    less than a, ``held`` lie inside. A pass takes the quantiles beside the
    wanted share of a sketch of the inside and counts what lies below and
    between them; a side that the counts do not confirm stays. Passes go on
    while a group holds more than ``ranked`` values that are not all equal."""
    if not group:
        return order_statistics(values.withColumn("_all", F.lit(1)), col, ["_all"], rank, ranked).drop("_all")
    v = values.where(F.col(col).isNotNull()).select(*group, F.col(col).cast("double").alias("v"))
    n = F.col("n")
    r = F.greatest(F.least(F.floor(rank(n)).cast("long"), n), F.lit(1))
    open_ = F.lit(None).cast("double")
    box = materialize(v.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(
        *group, "n", r.alias("r"), F.lit(0).cast("long").alias("below"), n.alias("held"), open_.alias("a"), open_.alias("b"), F.lit(False).alias("done")))
    facts = ["n", "r", "below", "held", "a", "b"]
    inside = (F.col("a").isNull() | (F.col("v") >= F.col("a"))) & (F.col("b").isNull() | (F.col("v") <= F.col("b")))

    def with_box(boxes: DataFrame, *more: str) -> DataFrame:
        """Values inside the brackets, with them."""
        keys = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in group]
        return v.alias("x").join(boxes.alias("y"), keys).where(inside).select("x.*", *facts, *more)

    while True:
        wide = ~F.col("done") & (F.col("held") > ranked) & (F.col("a").isNull() | F.col("b").isNull() | (F.col("a") < F.col("b")))
        big = box.where(wide)
        if big.isEmpty():
            break
        grid = F.percentile_approx("v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)
        at = F.floor((F.col("r") - F.col("below")) / F.col("held") * GRID).cast("int")  # the interval of the wanted rank
        low, high = F.when(at >= 3, F.get("q", at - 2)), F.when(at <= GRID - 4, F.get("q", at + 3))
        tried = with_box(big).groupBy(*group, *facts).agg(grid.alias("q")).withColumn("low", F.coalesce(low, "a")).withColumn("high", F.coalesce(high, "b"))
        under = F.coalesce(F.col("v") < F.col("low"), F.lit(False))
        over = F.coalesce(F.col("v") > F.col("high"), F.lit(False))
        found = with_box(materialize(tried.drop("q")), "low", "high").groupBy(*group, *facts, "low", "high").agg(F.count_if(under).alias("u"), F.count_if(over).alias("o"))
        good_low = F.col("below") + F.col("u") < F.col("r")
        good_high = F.col("below") + F.col("held") - F.col("o") >= F.least(F.col("r") + 1, n)
        cut_low, cut_high = F.when(good_low, F.col("u")).otherwise(0), F.when(good_high, F.col("o")).otherwise(0)
        step = found.select(*group, "n", "r", (F.col("below") + cut_low).alias("below"), (F.col("held") - cut_low - cut_high).alias("held"),
                            F.when(good_low, F.col("low")).otherwise(F.col("a")).alias("a"), F.when(good_high, F.col("high")).otherwise(F.col("b")).alias("b"),
                            (cut_low + cut_high == 0).alias("done"))  # few distinct values: no quantile parts them
        box = materialize(box.where(~wide).unionByName(step))
    counted = with_box(box).groupBy(*group, "n", "r", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto)
    up = F.least(F.col("r") + 1, n)
    return placed.groupBy(*group).agg(
        F.first("n").alias("n"), F.min(F.when(F.col("upto") >= F.col("r"), F.col("v"))).alias("lo"),
        F.min(F.when(F.col("upto") >= up, F.col("v"))).alias("hi"))


def p95_exclusive(values: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """The 95th percentile by the 'exclusive' method (rank 0.95 (n + 1), linear
    interpolation), as the reference's ``statistics.quantiles(n=20)[18]``,
    including its clamp and extrapolation for tiny n; one value is its own."""
    group = group or []
    rank = lambda n: F.greatest(F.least(F.floor(19 * (n + 1) / 20), n - 1), F.lit(1))
    s = order_statistics(values, col, group, rank)
    n = F.col("n")
    delta = 19 * (n + 1) - rank(n) * 20
    p = F.when(n < 2, F.col("lo")).otherwise((F.col("lo") * (20 - delta) + F.col("hi") * delta) / 20)
    return s.select(*group, p.alias("p95"))


def p95_inclusive(log: DataFrame, col: str, group: list[str], approx: bool = False) -> DataFrame:
    """The inclusive method (rank 0.95 (n - 1) + 1), exact or approximate."""
    if approx:
        return log.groupBy(*group).agg(F.percentile_approx(col, P95, ACCURACY).alias("p95"))
    at = lambda n: (n - 1) * P95 + 1
    s = order_statistics(log, col, group, at)
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    return s.select(*group, (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("p95"))


def error_histogram(log: DataFrame, ok: Column, msg: str) -> DataFrame:
    """Failures counted by their message cut to 100 characters."""
    return (log.where(~F.coalesce(ok, F.lit(False))).groupBy(F.substring(F.col(msg), 1, ERROR_TEXT_CHARS).alias("error"))
               .agg(F.count(F.lit(1)).alias("count")))


def load_verdict(summary: DataFrame) -> DataFrame:
    """The reference's warnings and verdicts over a latency summary."""
    share = F.col("successes") / F.col("total")
    return summary.select(
        "*",
        (share < SUCCESS_TARGET).alias("warn_errors"),
        (F.col("mean_rt") > SLOW_MEAN_SEC).alias("warn_slow"),
        (F.col("rps") < MIN_RPS).alias("warn_throughput"),
        F.when(share > STABLE_SHARE, "stable").otherwise("unstable").alias("stability"),
        F.when(F.col("mean_rt") < GOOD_MEAN_SEC, "good").otherwise("needs_optimisation")
        .alias("performance"),
    )


def latency_bands(log: DataFrame, rt_ms: Column) -> DataFrame:
    """Requests per response-time band (< 1000 ms, < 3000 ms, slower)."""
    band = (F.when(rt_ms < BAND_FAST_MS, "fast").when(rt_ms < BAND_OK_MS, "ok").otherwise("slow"))
    return log.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("count"))


def target_shares(rec: DataFrame) -> DataFrame:
    """Recommendations per target with share and mean confidence (one row
    per target; the window sees those few rows)."""
    g = rec.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
    return g.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
