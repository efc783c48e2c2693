"""Rule, recommendation and check queries.

The driver's tables are all small, so rules 1-7 are exercised on the
*projected* profile: each table's real profile scaled by growth factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.operators import checks as C
from tablesense.operators import design as D
from tablesense.operators import profile as P
from tablesense.operators import requestlog as L
from tablesense.operators import rules as R
from tablesense.plans import sqlgen as G
from tablesense.plans.catalog import SCHEMAS, TABLES, load_all
from tablesense.plans.registry import dec, joined, query
from tablesense.session import materialize

FACTORS = [1, 10, 100, 1000, 10000, 100000]


def _profiles(spark, sf_dir, mode="intended", dups=True):
    tables = load_all(spark, sf_dir)
    cp = materialize(P.catalog_column_profile(tables, "auto"))
    tp = materialize(P.table_profile(cp, P.catalog_duplicate_rows(tables) if dups else None, mode))
    return tables, cp, tp


def _projected_sql(mode: str) -> str:
    vals = ", ".join(f"({f})" for f in FACTORS)
    return (G.profile_ctes(TABLES, with_dups=False, mode=mode) + f""",
pp AS (
  SELECT tp.* REPLACE (tp.record_count * s.scale AS record_count,
                       tp.estimated_size_mb * s.scale AS estimated_size_mb), s.scale
  FROM tp, (VALUES {vals}) AS s(scale)),
rr AS ({G.rules_sql(mode)}),
m AS (SELECT p.table_name, p.scale, r.* FROM pp p JOIN rr r ON {G.RULE_PREDICATE_SQL}),
b AS (SELECT *, row_number() OVER (PARTITION BY table_name, scale ORDER BY priority DESC, ord) AS rn
      FROM m)
""")


def _best(spark, sf_dir, mode):
    _, _, tp = _profiles(spark, sf_dir, mode, dups=False)
    pp = R.projected_profile(tp, FACTORS)
    return R.best_rule(R.rule_matches(pp, R.rules_frame(spark, mode)))


@query("rule_matches", sql=_projected_sql("intended") + """
SELECT table_name, CAST(scale AS BIGINT) AS scale, ord AS rule_ord, name AS rule FROM m""")
def q_rule_matches(spark, sf_dir):
    _, _, tp = _profiles(spark, sf_dir, dups=False)
    pp = R.projected_profile(tp, FACTORS)
    return R.rule_matches(pp, R.rules_frame(spark)).select("table_name", "scale", "rule_ord", "rule")


BEST_SQL = """
SELECT table_name, CAST(scale AS BIGINT) AS scale, name AS rule, priority, target, confidence,
  schedule_hint FROM b WHERE rn = 1"""


@query("best_rule", sql=_projected_sql("intended") + BEST_SQL)
def q_best_rule(spark, sf_dir):
    return _best(spark, sf_dir, "intended").select("table_name", "scale", "rule", "priority", "target",
                                                   "confidence", "schedule_hint")


@query("best_rule_observed", sql=_projected_sql("observed") + BEST_SQL)
def q_best_rule_observed(spark, sf_dir):
    return _best(spark, sf_dir, "observed").select("table_name", "scale", "rule", "priority",
                                                   "target", "confidence", "schedule_hint")


# --------------------------------------------------------------------------
# checks
# --------------------------------------------------------------------------

# Source formats of the tables, for the format checks: flat tables as CSV, those
# with nested or JSON text as JSON, the others as XML.
FORMATS = {"events": "json", "documents": "json", "conversations": "json", "embeddings": "json", "pages": "xml", "benchmark": "xml",
           **{t: "csv" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "labels")}}
IS_FMT = {f: "table_name IN (" + ", ".join(f"'{t}'" for t, x in FORMATS.items() if x == f) + ")" for f in ("csv", "json", "xml")}


def _probe_sql() -> str:
    """Every string column, over all values."""
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, {i + 1} AS ordinal, '{c}' AS column_name, "
        f"coalesce(bool_or(contains({G.q(c)}, '{{') OR contains({G.q(c)}, '[')), false) AS nested_json FROM {t}"
        for t in TABLES for i, (c, kind, _) in enumerate(SCHEMAS[t]) if kind == "string")


@query("nested_string_probe", sql=_probe_sql())
def q_nested_string_probe(spark, sf_dir):
    return C.nested_string_probe(P.catalog_column_profile(load_all(spark, sf_dir), "none"))


QUALITY_SQL = """
SELECT table_name, 'error' AS severity, 'empty' AS "check", 'DataFrame is empty' AS detail
  FROM tp WHERE record_count = 0
UNION ALL
SELECT table_name, 'warning', 'nulls',
  printf('High percentage of null values: %.1f%%', null_cells * 100.0 / (record_count * field_count))
  FROM tp WHERE record_count > 0 AND null_cells * 100.0 / (record_count * field_count) > 80
UNION ALL
SELECT table_name, 'warning', 'duplicates', printf('High number of duplicate rows: %d', duplicate_rows)
  FROM tp WHERE record_count > 0 AND duplicate_rows > record_count * 0.5
UNION ALL
SELECT table_name, 'warning', 'many_columns', printf('High number of columns: %d', field_count)
  FROM tp WHERE record_count > 0 AND field_count > 100
UNION ALL
SELECT table_name, 'warning', 'few_columns', printf('Low number of columns: %d', field_count)
  FROM tp WHERE record_count > 0 AND field_count < 2
"""

TOKENS = G.tokens_sql("column_name")
FORMAT_SQL = f"""
SELECT table_name, 'warning' AS severity, 'numeric_low_cardinality' AS "check",
  printf('Column ''%s'' has low cardinality for numeric data', column_name) AS detail
  FROM cf WHERE {IS_FMT['csv']} AND kind IN ('int', 'float') AND ratio < 0.01 AND distinct_count > 1
UNION ALL
SELECT table_name, 'warning', 'nested_json',
  printf('Column ''%s'' may contain nested JSON structures', column_name)
  FROM probe WHERE {IS_FMT['json']} AND nested_json
UNION ALL
SELECT table_name, 'warning', 'spatial_name', printf('Column ''%s'' may contain spatial data', column_name)
  FROM cf WHERE {IS_FMT['xml']} AND regexp_matches({TOKENS}, '(^|_)(coord|lat|lon|x|y|geometry)(_|$)')
UNION ALL
SELECT table_name, 'warning', 'cadastral_name',
  printf('Column ''%s'' may contain cadastral information', column_name)
  FROM cf WHERE {IS_FMT['xml']} AND regexp_matches({TOKENS}, '(^|_)(cad|кадастр)(_|$)')
"""


def derived(spark, sf_dir, names: list[str]) -> dict[str, DataFrame]:
    """The tables of ``sqlgen.DERIVED``: inputs on which the checks fire."""
    t = load_all(spark, sf_dir, ["region", "nation", "part", "customer"])
    nothing = lambda c: F.nullif(F.col(c), F.col(c)).alias(c)
    out = {
        "region_none": t["region"].where("r_regionkey < 0"),
        "nation_nulled": t["nation"].select(*[nothing(c) for c in t["nation"].columns]),
        "region_repeated": t["region"].unionAll(t["region"]).unionAll(t["region"]),
        "part_names": t["part"].select("p_name"),
        "customer_wide": t["customer"].select(*[(F.col("c_custkey") + i).alias(f"k{i}") for i in range(101)]),
    }
    return {n: out[n] for n in names}


QUALITY_TABLES = [*TABLES, *G.DERIVED]


@query("quality_checks", sql=G.profile_ctes(QUALITY_TABLES) + QUALITY_SQL)
def q_quality_checks(spark, sf_dir):
    """Every check fires: on no rows, nulls, repeats, one column, 101 columns."""
    tables = load_all(spark, sf_dir) | derived(spark, sf_dir, list(G.DERIVED))
    cp = P.catalog_column_profile(tables, "none")
    return C.quality_checks(P.table_profile(cp, P.catalog_duplicate_rows(tables)))


@query("format_checks", sql=G.profile_ctes(TABLES, with_dups=False)
       + f", probe AS ({_probe_sql()})" + FORMAT_SQL)
def q_format_checks(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir), "auto")
    return C.format_checks(cp, FORMATS).drop("ordinal")


@query("numeric_low_card", sql=G.profile_ctes(TABLES, with_dups=False) + """
SELECT table_name, ordinal, column_name, distinct_count, row_count FROM cf
WHERE kind IN ('int', 'float') AND ratio < 0.01 AND distinct_count > 1""")
def q_numeric_low_card(spark, sf_dir):
    cp = P.catalog_column_profile(load_all(spark, sf_dir))
    return D.numeric_low_card(cp)


def recommend_frame(spark, sf_dir, mode="intended"):
    tables = load_all(spark, sf_dir) | derived(spark, sf_dir, ["region_none"])
    cp = materialize(P.catalog_column_profile(tables, "auto"))
    tp = materialize(P.table_profile(cp, P.catalog_duplicate_rows(tables), mode))
    checks = C.all_checks(tp, cp, FORMATS, mode)
    rec = R.recommend(tp, R.rules_frame(spark, mode), checks)
    return rec.select("table_name", "rule", "target", "confidence", "schedule_hint",
                      F.array_join("ddl_hints", " | ").alias("hints"),
                      joined(F.array_sort("errors")).alias("errors"),
                      joined(F.array_sort("warnings")).alias("warnings"))


RECOMMEND_SQL = (G.profile_ctes([*TABLES, "region_none"]) + f", probe AS ({_probe_sql()}), "
                 f"chk AS ({QUALITY_SQL} UNION ALL {FORMAT_SQL}), rr AS ({G.rules_sql()}), "
                 f"m AS (SELECT p.table_name, r.* FROM tp p JOIN rr r ON {G.RULE_PREDICATE_SQL}), "
                 "b AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY priority DESC, "
                 "ord) AS rn FROM m), "
                 "ck AS (SELECT table_name, "
                 "coalesce(string_agg(detail, ',' ORDER BY detail) FILTER (WHERE severity = 'error'), '') "
                 "AS errors, coalesce(string_agg(detail, ',' ORDER BY detail) "
                 "FILTER (WHERE severity = 'warning'), '') AS warnings FROM chk GROUP BY table_name)"
                 f"""
SELECT t.table_name,
  CASE WHEN coalesce(ck.errors, '') <> '' THEN 'quality_error' ELSE b.name END AS rule,
  CASE WHEN coalesce(ck.errors, '') <> '' THEN '{R.ERROR_TARGET}' ELSE b.target END AS target,
  CASE WHEN coalesce(ck.errors, '') <> '' THEN CAST({R.ERROR_CONFIDENCE} AS DECIMAL(4,2))
       ELSE b.confidence END AS confidence,
  CASE WHEN coalesce(ck.errors, '') <> '' THEN '{R.ERROR_SCHEDULE}' ELSE b.schedule_hint END
    AS schedule_hint,
  CASE WHEN coalesce(ck.errors, '') <> '' THEN '{R.ERROR_HINT}' ELSE b.hints END AS hints,
  coalesce(ck.errors, '') AS errors, coalesce(ck.warnings, '') AS warnings
FROM tp t LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (table_name)
LEFT JOIN ck USING (table_name)""")


@query("recommend", sql=RECOMMEND_SQL)
def q_recommend(spark, sf_dir):
    """All tables, and one without rows, which ends in the error path."""
    return recommend_frame(spark, sf_dir)


@query("target_distribution", sql=f"""
SELECT target, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DECIMAL(38,6)) AS percent,
  CAST(avg(confidence) AS DECIMAL(38,6)) AS mean_confidence
FROM ({RECOMMEND_SQL}) r GROUP BY target""")
def q_target_distribution(spark, sf_dir):
    """Shares of the catalog's own recommendations."""
    s = L.target_shares(recommend_frame(spark, sf_dir))
    return s.select("target", F.col("n").cast("long").alias("n"), dec("percent").alias("percent"),
                    dec("mean_confidence").alias("mean_confidence"))
