"""Rule table, rule matching (J1/P14), best rule (W1) and recommendation (V6).

The rule table is a fixed 10-row DataFrame; matching is a join of
``table_profile`` with the broadcast rule table on a null-tolerant theta
predicate (a condition left NULL is not checked). The output is bounded
by 10 rows per table. The best rule is ``row_number() = 1`` per table
ordered by priority (number of conditions) then listing order, which is
the reference's strict '>' tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "ord int, name string, has_temporal boolean, has_text boolean, has_categorical boolean, "
    "has_spatial boolean, has_nested boolean, mb_gt double, mb_lt double, mb_ge double, "
    "mb_le double, rows_gt long, rows_lt long, rows_ge long, rows_le long, fields_gt int, "
    "fields_lt int, priority int, target string, confidence decimal(4,2), schedule_hint string, "
    "rationale string, ddl_hints array<string>"
)

# ---------------------------------------------------------------------------
# The ten rules, in the reference's order (hints in English).
# Columns: ord, name, temporal, text, categorical, spatial, nested,
#          mb >, mb <, mb >=, mb <=, rows >, rows <, rows >=, rows <=,
#          fields >, fields <, priority, target, confidence, schedule.
# ---------------------------------------------------------------------------
RULES = [
    (1, "very_large_temporal_data", True, None, None, None, None,
     500.0, None, None, None, 1000000, None, None, None, None, None, 3,
     "clickhouse", "0.95", "hourly",
     "Very large time-series volumes need fast analytical queries; ClickHouse is built for them.",
     ["Use MergeTree partitioned by day or month",
      "ORDER BY the time column and the id",
      "Enable column compression",
      "Set a TTL to drop stale data"]),
    (2, "large_temporal_data", True, None, None, None, None,
     100.0, None, None, None, 100000, None, None, None, None, None, 3,
     "clickhouse", "0.90", "daily",
     "Large time-series data suits ClickHouse aggregation and compression.",
     ["Partition by date",
      "ORDER BY the columns of frequent queries",
      "Use the MergeTree engine"]),
    (3, "cadastral_spatial_data", None, None, None, True, True,
     None, None, None, None, None, None, None, None, 15, None, 3,
     "postgresql", "0.92", "realtime",
     "Spatial, nested cadastral records need PostGIS and JSONB.",
     ["Use PostGIS for geometry",
      "Create GiST indexes on spatial columns",
      "Keep attributes in JSONB",
      "Index the cadastral number"]),
    (4, "complex_nested_structures", None, True, None, None, True,
     None, None, None, None, None, None, None, None, 20, None, 3,
     "postgresql", "0.85", "hourly",
     "Deeply nested records with text fit JSONB with full-text search.",
     ["Store nested parts as JSONB",
      "Create GIN indexes for full-text search",
      "Model links between tables"]),
    (5, "business_entities_data", None, True, True, None, None,
     50.0, None, None, None, None, None, None, None, 10, None, 4,
     "postgresql", "0.80", "daily",
     "Business entities with categories and text need constraints and relations.",
     ["Add integrity constraints",
      "Create a unique index on tax and registration numbers",
      "Enable text search",
      "Declare foreign keys"]),
    (6, "massive_archive_data", None, None, None, None, None,
     5000.0, None, None, None, 10000000, None, None, None, None, None, 2,
     "hdfs", "0.90", "weekly",
     "Massive archives are cheapest as columnar files on a distributed file system.",
     ["Store as Parquet or ORC",
      "Partition by year and month",
      "Compress with Snappy or ZSTD",
      "Split hot and cold data"]),
    (7, "large_archive_data", None, None, None, None, None,
     1000.0, None, None, None, 1000000, None, None, None, None, None, 2,
     "hdfs", "0.80", "weekly",
     "Large archives fit columnar files on a distributed file system.",
     ["Store as Parquet",
      "Partition by date",
      "Enable compression"]),
    (8, "small_dataset", None, None, None, None, None,
     None, 10.0, None, None, None, 10000, None, None, None, None, 2,
     "postgresql", "0.70", "daily",
     "Small datasets are simplest in a relational database.",
     ["Choose exact column types",
      "Add indexes on lookup columns",
      "Keep the default schema"]),
    (9, "medium_mixed_data", None, None, None, None, None,
     None, None, 10.0, 100.0, None, None, 10000, 100000, None, None, 2,
     "postgresql", "0.75", "daily",
     "Medium mixed data fits a relational database with tuned indexes.",
     ["Choose exact column types",
      "Add composite indexes",
      "Consider materialised views"]),
    (10, "default_recommendation", None, None, None, None, None,
     None, None, None, None, None, None, None, None, None, None, 0,
     "postgresql", "0.60", "daily",
     "No specific pattern found; a relational database is the safe default.",
     ["Analyse the data structure",
      "Choose exact column types",
      "Add basic indexes"]),
]
# Recommendation when the quality checks report an error.
ERROR_TARGET, ERROR_CONFIDENCE, ERROR_SCHEDULE = "postgresql", "0.10", "daily"
ERROR_HINT = "Fix data quality issues before loading"
# end of fixed values


def rules_frame(spark: SparkSession, mode: str = "intended") -> DataFrame:
    """The rule table. In observed mode rule 9 keeps only its '<=' bounds,
    which the reference's evaluator ignores, so it matches everything."""
    from decimal import Decimal
    rows = []
    for r in RULES:
        r = list(r)
        r[19] = Decimal(r[19])
        if mode == "observed" and r[1] == "medium_mixed_data":
            r[9] = r[10] = r[11] = r[12] = r[13] = r[14] = None
        rows.append(tuple(r))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _eq(profile_flag: str) -> Column:
    rule = F.col(f"r.{profile_flag}")
    return rule.isNull() | (F.col(f"p.{profile_flag}") == rule)


def _cmp(value: str, bound: str, op) -> Column:
    b = F.col(f"r.{bound}")
    return b.isNull() | op(F.col(f"p.{value}"), b)


def rule_predicate() -> Column:
    import operator as o
    return (_eq("has_temporal") & _eq("has_text") & _eq("has_categorical")
            & _eq("has_spatial") & _eq("has_nested")
            & _cmp("estimated_size_mb", "mb_gt", o.gt) & _cmp("estimated_size_mb", "mb_lt", o.lt)
            & _cmp("estimated_size_mb", "mb_ge", o.ge) & _cmp("estimated_size_mb", "mb_le", o.le)
            & _cmp("record_count", "rows_gt", o.gt) & _cmp("record_count", "rows_lt", o.lt)
            & _cmp("record_count", "rows_ge", o.ge) & _cmp("record_count", "rows_le", o.le)
            & _cmp("field_count", "fields_gt", o.gt) & _cmp("field_count", "fields_lt", o.lt))


def rule_matches(tp: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (table, rule) pair whose conditions hold (broadcast theta join)."""
    j = tp.alias("p").join(F.broadcast(rules.alias("r")), rule_predicate(), "inner")
    keys = [F.col(f"p.{k}").alias(k) for k in _keys(tp)]
    return j.select(*keys, F.col("r.ord").alias("rule_ord"),
                    F.col("r.name").alias("rule"), F.col("r.priority").alias("priority"),
                    F.col("r.target").alias("target"), F.col("r.confidence").alias("confidence"),
                    F.col("r.schedule_hint").alias("schedule_hint"),
                    F.col("r.rationale").alias("rationale"), F.col("r.ddl_hints").alias("ddl_hints"))


def _keys(df: DataFrame) -> list[str]:
    """Row key of a profile: the table, plus the growth factor of a
    projected profile."""
    return ["table_name"] + (["scale"] if "scale" in df.columns else [])


def projected_profile(tp: DataFrame, factors: list[int]) -> DataFrame:
    """The profile each table would have at ``factor`` times its rows and
    bytes (flags and column count unchanged): a what-if for growth, made by
    ``explode`` (no join)."""
    f = F.explode(F.array(*[F.lit(x).cast("long") for x in factors])).alias("scale")
    return (tp.select("*", f)
              .withColumn("record_count", F.col("record_count") * F.col("scale"))
              .withColumn("estimated_size_mb", F.col("estimated_size_mb") * F.col("scale")))


def best_rule(matches: DataFrame) -> DataFrame:
    """Highest priority, first listed on ties; the default rule (priority 0)
    is taken only when nothing else matches."""
    w = Window.partitionBy(*_keys(matches)).orderBy(F.col("priority").desc(), F.col("rule_ord"))
    return matches.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def recommend(tp: DataFrame, rules: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """One recommendation per table. Tables with a quality error get the
    error recommendation (V6) instead of the rule result."""
    best = best_rule(rule_matches(tp, rules))
    rec = tp.select(*_keys(tp)).join(best, _keys(tp), "left")
    if checks is None:
        return rec.withColumn("errors", F.array().cast("array<string>")) \
                  .withColumn("warnings", F.array().cast("array<string>"))
    sev = checks.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("severity") == "error", F.col("detail")))).alias("errors"),
        F.array_sort(F.collect_list(F.when(F.col("severity") == "warning", F.col("detail")))).alias("warnings"),
    )
    rec = rec.join(sev, "table_name", "left").select(
        "*",
    )
    failed = F.coalesce(F.size("errors"), F.lit(0)) > 0
    return (rec.withColumn("rule", F.when(failed, F.lit("quality_error")).otherwise(F.col("rule")))
               .withColumn("target", F.when(failed, F.lit(ERROR_TARGET)).otherwise(F.col("target")))
               .withColumn("confidence", F.when(failed, F.lit(ERROR_CONFIDENCE).cast("decimal(4,2)"))
                           .otherwise(F.col("confidence")))
               .withColumn("schedule_hint", F.when(failed, F.lit(ERROR_SCHEDULE))
                           .otherwise(F.col("schedule_hint")))
               .withColumn("ddl_hints", F.when(failed, F.array(F.lit(ERROR_HINT)))
                           .otherwise(F.col("ddl_hints")))
               .withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
               .withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))))
