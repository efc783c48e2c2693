"""Request log, store, streaming, sampling, plan shape and the driver entry."""

import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF001


def test_p95_exclusive_matches_python(spark):
    from tablesense.operators import requestlog as L
    vals = [float((i * 7919) % 1000) / 10 for i in range(1, 501)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = L.p95_exclusive(df, "v").first()["p95"]
    assert got == pytest.approx(statistics.quantiles(vals, n=20)[18], rel=1e-12)


def test_store_hits_and_misses(spark, tmp_dir):
    from tablesense.operators import store as S
    a = spark.createDataFrame([(1, "x")], "a long, b string")
    b = spark.createDataFrame([(2, "y")], "a long, b string")
    fps = S.fingerprints({"a": a, "b": b})
    res = spark.createDataFrame([("a", 1), ("b", 1)], "table_name string, rows long")
    rows = S.entries(res, fps, "table_profile", 1000).withColumn(
        "written_at", F.when(F.col("table_name") == "a", 900).otherwise(-5000).cast("long"))
    S.write(rows, tmp_dir)
    store = S.read_latest(spark, tmp_dir)
    assert [r["table_name"] for r in S.hits(fps, store, 1000).collect()] == ["a"]
    assert [r["table_name"] for r in S.misses(fps, store, 1000).collect()] == ["b"]
    # new content for 'a' -> miss
    fps2 = S.fingerprints({"a": a.union(b), "b": b})
    assert sorted(r["table_name"] for r in S.misses(fps2, store, 1000).collect()) == ["a", "b"]
    st = S.stats(spark.read.parquet(tmp_dir), 1000).first()
    assert (st["entries"], st["valid"], st["expired"]) == (2, 1, 1)


def test_stream_equals_batch(spark):
    from tablesense.operators import design as D
    from tablesense.session import scratch_path
    from tablesense.streaming import jobs as J
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    stream = J.file_stream(spark, SF001, "events.parquet", ev.schema)
    s = J.daily_rollup_stream(spark, stream, "events", scratch_path(spark, "t-out"),
                              scratch_path(spark, "t-ckpt"))
    b = D.daily_rollup_tall(ev, "events").withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_sample_is_reproducible(spark):
    from tablesense.operators import sampling as S
    od = spark.read.parquet(f"{SF001}/orders.parquet")
    a = [r[0] for r in S.sample_n(od, ["o_orderkey"], 20).select("o_orderkey").collect()]
    b = [r[0] for r in S.sample_n(od, ["o_orderkey"], 20).select("o_orderkey").collect()]
    assert a == b and len(set(a)) == 20


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_udf_or_cartesian(spark):
    from tablesense.plans import load_queries
    qs, _ = load_queries()
    for name in ["column_profile", "table_profile", "recommend", "best_rule", "ddl_script",
                 "nested_string_probe", "tag_discovery", "latency_summary"]:
        plan = _plan(qs[name](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_window_top_k_is_bounded_before_shuffle(spark):
    from tablesense.operators import design as D
    cp = spark.range(100).selectExpr("concat('t', id % 2) AS table_name", "CAST(id AS INT) AS ordinal", "'c' AS column_name").repartition(3)
    assert "WindowGroupLimit" in _plan(D.column_roles(cp, most=15))
    assert D.column_roles(cp, most=15).count() == 30 and D.column_roles(cp).count() == 100


def test_late_days_and_rerun_batches_count_once(spark, tmp_dir):
    """Three files out of time order, one per micro-batch."""
    from tablesense.operators import design as D
    from tablesense.streaming import jobs as J
    import datetime as dt
    schema = "ts timestamp_ntz, v double"
    days = [dt.datetime(2024, 3, d) for d in (10, 20, 1)]
    for d in days:
        spark.createDataFrame([(d, 1.5), (d, 2.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    df = spark.read.parquet(f"{tmp_dir}/in")
    for _ in range(2):  # a restart finds nothing new
        stream = J.file_stream(spark, f"{tmp_dir}/in", "*.parquet", df.schema, max_files=1)
        got = J.daily_rollup_stream(spark, stream, "t", f"{tmp_dir}/out", f"{tmp_dir}/ckpt").collect()
        want = D.daily_rollup_tall(df, "t").withColumn("date", F.date_format("date", "yyyy-MM-dd")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_stream_profiles_merge(spark, tmp_dir):
    from tablesense.operators import profile as P
    from tablesense.streaming import jobs as J
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.repartition(4).write.parquet(f"{tmp_dir}/in")
    stream = J.file_stream(spark, f"{tmp_dir}/in", "*.parquet", ev.schema, max_files=1)
    got = {r["column_name"]: r for r in J.profile_stream(spark, stream, "events", f"{tmp_dir}/out", f"{tmp_dir}/ckpt").collect()}
    for r in P.column_profile(ev, "events").collect():
        m = got[r["column_name"]]
        for c in ("row_count", "null_count", "byte_size", "min_num", "max_num", "ts_min", "ts_max", "timestamp_ok", "numeric_hit", "nested_hit"):
            assert m[c] == r[c], c
        assert abs(m["distinct_estimate"] - r["distinct_count"]) <= max(2, 0.1 * r["distinct_count"])


def test_streamed_duplicates_quality_and_fingerprint(spark, tmp_dir):
    """Files out of order, a restart, a run without files, maps and nulls: the
    streamed table profile is the batch one."""
    from tablesense.operators import profile as P
    from tablesense.operators import store as S
    from tablesense.streaming import jobs as J
    rows = spark.createDataFrame([(i % 5 if i % 4 else None, f"x{i % 3}" if i % 7 else None, {"a": i % 2}) for i in range(60)],
                                 "a long, b string, m map<string,int>")
    run = lambda: J.table_profile_stream(
        spark, J.file_stream(spark, f"{tmp_dir}/in", "*.parquet", rows.schema, max_files=1), "t", f"{tmp_dir}/out", f"{tmp_dir}/ckpt", f"{tmp_dir}/store", 50).first()
    import os
    os.makedirs(f"{tmp_dir}/in")
    assert run().record_count == 0
    for part in ("b = 'x2'", "b = 'x0' OR b IS NULL", "b = 'x1'"):
        rows.where(part).repartition(2).write.mode("append").parquet(f"{tmp_dir}/in")
        got = run()
    again = run()  # nothing new
    want = P.table_profile(P.column_profile(rows, "t"), P.duplicate_rows(rows, "t")).first()
    for c in ("record_count", "field_count", "null_cells", "duplicate_rows", "null_ratio", "quality_score", "estimated_size_mb", "has_nested", "has_text"):
        assert got[c] == want[c] == again[c], c
    assert got.duplicate_rows > 0
    fp = S.fingerprints({"t": rows})
    assert fp.first().content_hash == got.content_hash == again.content_hash
    latest = S.read_latest(spark, f"{tmp_dir}/store")
    assert S.hits(fp, latest, 60).count() == 1 and S.hits(S.fingerprints({"t": rows.limit(59)}), latest, 60).count() == 0


def test_content_that_returns_is_found_and_old_rows_expire(spark, tmp_dir):
    from tablesense.operators import store as S
    a, b = (spark.createDataFrame([(i,)], "a long") for i in (1, 2))
    res = spark.createDataFrame([("t", 1)], "table_name string, rows long")
    for df, at in ((a, 100), (b, 200)):
        S.write(S.entries(res, S.fingerprints({"t": df}), "x", at), f"{tmp_dir}/s")
    latest = S.read_latest(spark, f"{tmp_dir}/s")
    assert S.hits(S.fingerprints({"t": a}), latest, 300, 250).count() == 1
    kept = S.expire(spark, f"{tmp_dir}/s", f"{tmp_dir}/v2", 300, 150)
    assert [r["written_at"] for r in kept.collect()] == [200]


def test_parse_facts(spark, tmp_dir, monkeypatch):
    """Format, strategy and structure follow from the files and their rows."""
    from tablesense.operators import profile as P
    from tablesense.operators import store as S
    from tablesense.sources import readers as RD
    monkeypatch.setattr(S, "XML_WHOLE_ROWS", 20)
    monkeypatch.setattr(S, "CSV_WHOLE_ROWS", 30)
    put = lambda df, name: df.write.format("xml").option("rowTag", "item").option("rootTag", "root").save(f"{tmp_dir}/{name}")
    put(spark.range(25).selectExpr("named_struct('cad_number', id) AS d"), "cad")
    put(spark.range(5).selectExpr("id AS v"), "small")
    for n, name in ((29, "short"), (31, "long")):
        spark.range(n).selectExpr("id AS a", "id AS b").write.option("header", True).csv(f"{tmp_dir}/{name}")
    tables = {t: RD.read_xml(spark, f"{tmp_dir}/{t}") for t in ("cad", "small")} | {t: RD.read_csv(spark, f"{tmp_dir}/{t}") for t in ("short", "long")}
    got = S.parse_facts(spark, {t: f"{tmp_dir}/{t}/part-*" for t in tables}, P.catalog_column_profile(tables, "none")).collect()
    assert {r["table_name"]: (r["format"], r["strategy"], r["xml_structure"]) for r in got} == {
        "cad": ("xml", "streaming", "cadastral"), "small": ("xml", "full", "generic"), "short": ("csv", "full", None), "long": ("csv", "chunked", None)}
    assert all(r["file_mb"] > 0 for r in got)


def test_one_request_and_null_flags(spark):
    from tablesense.operators import requestlog as L
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", t, True, 1.0, None), ("b", t, None, 2.0, "e"), ("b", t, False, 3.0, "e")], "g string, ts timestamp, ok boolean, rt double, m string")
    s = {r["g"]: r for r in L.latency_summary(log, ["g"], "ts", F.col("ok"), "rt").collect()}
    assert s["a"]["rps"] is None and s["a"]["successes"] == 1 and s["b"]["success_pct"] == 0 and s["b"]["error_pct"] == 100
    assert L.load_verdict(L.latency_summary(log, ["g"], "ts", F.col("ok"), "rt")).count() == 2
    assert [(r["error"], r["count"]) for r in L.error_histogram(log, F.col("ok"), "m").collect()] == [("e", 2)]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 400, 30_000])
@pytest.mark.parametrize("kind", ["spread", "few", "one"])
def test_exact_percentiles_from_a_bracket(spark, n, kind):
    from tablesense.operators import requestlog as L
    vals = [{"spread": (i * 7919) % 100_003 / 7, "few": float(i % 3), "one": 7.0}[kind] for i in range(n)]
    df = spark.createDataFrame([(v, "g") for v in vals] + [(None, "g")], "v double, g string")
    for method, f in (("exclusive", L.p95_exclusive), ("inclusive", L.p95_inclusive)):
        want = statistics.quantiles(vals, n=20, method=method)[18] if n > 1 else vals[0]
        assert f(df, "v", ["g"]).first()["p95"] == pytest.approx(want, rel=1e-12)


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    from tablesense import session

    class Fake:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15 and {r["target"] for r in rows} == {"postgresql"}
    assert [r["table_name"] for r in rows if r["rule"] == "quality_error"] == ["region_none"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_contract_imports_without_session():
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as E; "
            "q = E.queries(); o = E.oracle_sql(); assert set(o) <= set(q) and len(q) > 60")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    r = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=300)
    assert r.returncode == 0, r.stderr.decode()[-2000:]


def test_order_statistics_in_passes(spark):
    """Brackets narrowed until few values are left: exact at any size, with
    ties, nulls, infinities and tiny groups."""
    import math
    from pyspark.sql import functions as F
    from tablesense.operators import requestlog as L
    df = spark.range(60_000).select((F.col("id") % 4).alias("g"), F.when(F.col("id") % 97 > 0, (F.col("id") * 7919 % 30_011) / 7.0).alias("v"))
    df = df.unionAll(spark.createDataFrame([(None, 1.0), (None, 3.0), (5, 2.5), (6, math.inf), (6, -math.inf), (7, None)], "g long, v double"))
    df = df.unionAll(spark.range(9_000).select(F.lit(8).cast("long"), (F.col("id") % 2).cast("double")))
    groups = {}
    for r in df.where("v IS NOT NULL").collect():
        groups.setdefault(r.g, []).append(r.v)
    for share in (0.5, 0.95, 1.0, 0.0):
        got = {r.g: (r.n, r.lo, r.hi) for r in L.order_statistics(df, "v", ["g"], lambda n: n * share, ranked=20).collect()}
        want = {}
        for g, vs in groups.items():
            vs.sort()
            k = max(1, min(len(vs), math.floor(len(vs) * share)))
            want[g] = (len(vs), vs[k - 1], vs[min(k, len(vs) - 1)])
        assert got == want, share


def test_json_strings_of_arrays_and_of_many_keys(spark):
    from pyspark.sql import functions as F
    from tablesense.sources import flatten as FT
    df = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2, "b": "x"}]'), (2, "[]"), (3, None), (4, "broken")], "k long, j string")
    got = [tuple(r) for r in FT.expand_json_string(df, "j").orderBy("k", "j_index").collect()]
    assert got == [(1, 0, 1, None), (1, 1, 2, "x"), (2, None, None, None), (3, None, None, None), (4, None, None, None)]
    many = spark.range(100_000).select("id", F.concat(F.lit('{"k'), "id", F.lit('": {"v": '), "id", F.lit("}}")).alias("j"))
    assert FT.json_string_schema(many, "j") == "MAP<STRING, STRING>"
    assert FT.expand_json_string(many, "j").where("id = 77").first()["j"] == {"k77": '{"v":77}'}
    numbers = spark.createDataFrame([("[1, 2]",), ("[3]",)], "j string")
    assert sorted(tuple(r) for r in FT.expand_json_string(numbers, "j").collect()) == [(0, 1), (0, 3), (1, 2)]


def test_stream_files_follow_the_size_of_the_table(spark, tmp_dir):
    import glob

    from tablesense.plans import q_stream as Q
    path, each = Q._files(spark.range(0, 2300, 1, 23).withColumn("id", F.lit(1)), "files", spark)
    sizes = [spark.read.parquet(f).count() for f in glob.glob(f"{path}/*.parquet")]
    assert each == 5 and len(sizes) == 25 and sum(sizes) == 2300 and max(sizes) <= 2 * 2300 / 25
    assert Q._files(spark.range(0), "none", spark)[1] >= 1
