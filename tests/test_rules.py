"""Rule table: F6 tie-break, every bound on both sides, both modes, errors."""

import pytest
from pyspark.sql import functions as F

from tablesense.operators import rules as R

PROFILE = ("table_name string, record_count long, field_count int, has_temporal boolean, "
           "has_text boolean, has_categorical boolean, has_spatial boolean, has_nested boolean, "
           "estimated_size_mb double")


def best(spark, rows, mode="intended"):
    tp = spark.createDataFrame(rows, PROFILE)
    out = R.recommend(tp, R.rules_frame(spark, mode)).collect()
    return {r["table_name"]: r for r in out}


def test_f6_business_beats_temporal(spark):
    r = best(spark, [("f6", 1_000_000, 25, True, True, True, False, False, 150.5)])["f6"]
    assert r["rule"] == "business_entities_data" and r["target"] == "postgresql"
    assert float(r["confidence"]) == 0.8


@pytest.mark.parametrize("mb,rows,fields,flags,mode,expected", [
    (500.01, 1_000_001, 5, (True, False, False, False, False), "intended", "very_large_temporal_data"),
    (500.0, 1_000_001, 5, (True, False, False, False, False), "intended", "large_temporal_data"),
    (100.0, 100_001, 5, (True, False, False, False, False), "intended", "default_recommendation"),
    (100.01, 100_001, 5, (True, False, False, False, False), "intended", "large_temporal_data"),
    (10.0, 5000, 16, (False, False, False, True, True), "intended", "cadastral_spatial_data"),
    (10.0, 5000, 15, (False, False, False, True, True), "intended", "default_recommendation"),
    (1.0, 100, 21, (False, True, False, False, True), "intended", "complex_nested_structures"),
    (50.01, 5000, 11, (False, True, True, False, False), "intended", "business_entities_data"),
    (5000.01, 10_000_001, 5, (False, False, False, False, False), "intended", "massive_archive_data"),
    (5000.0, 10_000_001, 5, (False, False, False, False, False), "intended", "large_archive_data"),
    (9.99, 9999, 5, (False, False, False, False, False), "intended", "small_dataset"),
    (10.0, 9999, 5, (False, False, False, False, False), "intended", "default_recommendation"),
    (10.0, 10_000, 5, (False, False, False, False, False), "intended", "medium_mixed_data"),
    (100.0, 100_000, 5, (False, False, False, False, False), "intended", "medium_mixed_data"),
    (100.01, 100_000, 5, (False, False, False, False, False), "intended", "default_recommendation"),
    (100.01, 100_000, 5, (False, False, False, False, False), "observed", "medium_mixed_data"),
    (0.5, 10, 2, (False, False, False, False, False), "observed", "small_dataset"),
])
def test_rule_bounds(spark, mb, rows, fields, flags, mode, expected):
    t, x, c, s, n = flags
    r = best(spark, [("t", rows, fields, t, x, c, s, n, mb)], mode)["t"]
    assert r["rule"] == expected


def test_errors_short_circuit(spark):
    tp = spark.createDataFrame([("e", 0, 3, False, False, False, False, False, 0.0)], PROFILE)
    checks = spark.createDataFrame([("e", "error", "empty", "DataFrame is empty")],
                                   "table_name string, severity string, check string, detail string")
    r = R.recommend(tp, R.rules_frame(spark), checks).first()
    assert r["target"] == "postgresql" and float(r["confidence"]) == 0.1
    assert r["errors"] == ["DataFrame is empty"]


def test_projected_profile(spark):
    tp = spark.createDataFrame([("o", 15000, 6, True, True, True, False, False, 0.6)], PROFILE)
    pp = R.projected_profile(tp, [1, 1000]).orderBy("scale").collect()
    assert [r["record_count"] for r in pp] == [15000, 15_000_000]
