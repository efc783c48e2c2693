"""Request-log queries (A22-A26) with ``events`` as the log: one event is
one request, ``event_type = 'error'`` a failure, ``value`` the response
time in seconds, ``props`` the error text, the day of ``ts`` the scenario."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense.operators import requestlog as L
from tablesense.plans.catalog import load
from tablesense.plans.registry import dec, query


def _log(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def ok():
    """A request succeeded unless its event type is 'error'."""
    return F.col("event_type") != "error"


OK_SQL = "event_type <> 'error'"

SUMMARY_SQL = f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE {OK_SQL}) AS BIGINT) AS successes,
  CAST(count(*) FILTER (WHERE {OK_SQL}) * 100.0 / count(*) AS DECIMAL(38,6)) AS success_pct,
  CAST(count(*) FILTER (WHERE NOT ({OK_SQL})) * 100.0 / count(*) AS DECIMAL(38,6)) AS error_pct,
  CAST(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0) AS DECIMAL(38,6)) AS rps,
  CAST(avg(value) FILTER (WHERE {OK_SQL}) AS DECIMAL(38,6)) AS mean_rt,
  CAST(min(value) FILTER (WHERE {OK_SQL}) AS DECIMAL(38,6)) AS min_rt,
  CAST(max(value) FILTER (WHERE {OK_SQL}) AS DECIMAL(38,6)) AS max_rt,
  CAST(avg(CAST(json_extract(props, '$.k') AS DOUBLE) / 100) FILTER (WHERE {OK_SQL}) AS DECIMAL(38,6)) AS mean_confidence,
  any_value(p95_rt) AS p95_rt
FROM events LEFT JOIN ({{p95}}) p ON p.pday = strftime(ts, '%Y-%m-%d') GROUP BY 1"""
P95_SQL = f"""
SELECT pday, CAST(CASE WHEN any_value(n) < 2 THEN max(value) ELSE
    (max(value) FILTER (WHERE rn = j) * (20 - (19 * (n + 1) - j * 20)) + max(value) FILTER (WHERE rn = j + 1) * (19 * (n + 1) - j * 20)) / 20 END AS DECIMAL(38,6)) AS p95_rt
FROM (SELECT *, least(greatest((19 * (n + 1)) // 20, 1), greatest(n - 1, 1)) AS j FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS pday, value, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value) AS rn,
    count(*) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')) AS n FROM events WHERE {OK_SQL} AND value IS NOT NULL)) GROUP BY pday, n, j"""
SUMMARY_SQL = SUMMARY_SQL.replace("{p95}", P95_SQL)


def _summary(spark, sf_dir):
    """The number in an event's JSON stands for the confidence, in percent."""
    confidence = F.get_json_object("props", "$.k").cast("double") / 100
    return L.latency_summary(_log(spark, sf_dir), ["day"], "ts", ok(), "value", confidence)


@query("latency_summary", sql=SUMMARY_SQL)
def q_latency_summary(spark, sf_dir):
    s = _summary(spark, sf_dir)
    return s.select("day", F.col("total").cast("long"), F.col("successes").cast("long"),
                    *[dec(c).alias(c) for c in ["success_pct", "error_pct", "rps", "mean_rt",
                                                "min_rt", "max_rt", "mean_confidence", "p95_rt"]])


@query("p95_exclusive", sql=f"""
WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n
           FROM events WHERE {OK_SQL}),
k AS (SELECT any_value(n) AS n,
             least(greatest((19 * (any_value(n) + 1)) // 20, 1), any_value(n) - 1) AS j FROM v),
d AS (SELECT n, j, 19 * (n + 1) - j * 20 AS delta FROM k)
SELECT CAST(((SELECT value FROM v, d WHERE rn = d.j) * (20 - (SELECT delta FROM d))
        + (SELECT value FROM v, d WHERE rn = d.j + 1) * (SELECT delta FROM d)) / 20
       AS DECIMAL(38,6)) AS p95""")
def q_p95_exclusive(spark, sf_dir):
    ev = _log(spark, sf_dir).where(ok())
    return L.p95_exclusive(ev, "value").select(dec("p95").alias("p95"))


@query("p95_inclusive", sql=f"""
SELECT strftime(ts, '%Y-%m-%d') AS day,
  CAST(quantile_cont(value, 0.95) AS DECIMAL(38,6)) AS p95
FROM events WHERE {OK_SQL} GROUP BY 1""")
def q_p95_inclusive(spark, sf_dir):
    ev = _log(spark, sf_dir).where(ok())
    return L.p95_inclusive(ev, "value", ["day"]).select("day", dec("p95").alias("p95"))


@query("error_histogram", sql=f"""
SELECT substr(props, 1, 100) AS error, CAST(count(*) AS BIGINT) AS count
FROM events WHERE NOT ({OK_SQL}) GROUP BY 1""")
def q_error_histogram(spark, sf_dir):
    return L.error_histogram(_log(spark, sf_dir), ok(), "props").select(
        "error", F.col("count").cast("long"))


@query("load_verdict", sql=f"""
WITH s AS ({SUMMARY_SQL.replace('CAST(', 'CAST(').replace('AS DECIMAL(38,6))', 'AS DOUBLE)')})
SELECT day, successes * 1.0 / total < 0.95 AS warn_errors, mean_rt > 5.0 AS warn_slow,
  rps < 1.0 AS warn_throughput,
  CASE WHEN successes * 1.0 / total > 0.9 THEN 'stable' ELSE 'unstable' END AS stability,
  CASE WHEN mean_rt < 2.0 THEN 'good' ELSE 'needs_optimisation' END AS performance
FROM s""")
def q_load_verdict(spark, sf_dir):
    v = L.load_verdict(_summary(spark, sf_dir))
    return v.select("day", "warn_errors", "warn_slow", "warn_throughput", "stability",
                    "performance")


@query("latency_bands", sql="""
SELECT CASE WHEN value * 1000 < 1000 THEN 'fast' WHEN value * 1000 < 3000 THEN 'ok' ELSE 'slow' END
  AS band, CAST(count(*) AS BIGINT) AS count
FROM events GROUP BY 1""")
def q_latency_bands(spark, sf_dir):
    return L.latency_bands(_log(spark, sf_dir), F.col("value") * 1000).select(
        "band", F.col("count").cast("long"))
