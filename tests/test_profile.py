"""Column/table profile: hand-computed fixtures (FIXTURES F5, F2) and properties."""

import pytest

from tablesense.operators import profile as P

from conftest import SF001


def csv_small(spark):
    """F5 'CSV small': id 1..100, name Item_i, value, category A-C (deterministic)."""
    rows = [(i, f"Item_{i}", (i * 37) % 1000 + 1, "ABC"[i % 3]) for i in range(1, 101)]
    return spark.createDataFrame(rows, "id long, name string, value long, category string")


def test_csv_small_profile(spark):
    cp = P.column_profile(csv_small(spark), "csv_small")
    tp = P.table_profile(cp, P.duplicate_rows(csv_small(spark), "csv_small")).first()
    assert tp["record_count"] == 100 and tp["field_count"] == 4
    assert tp["unique_ids"][0] == "id"
    assert tp["has_categorical"] is True          # category: 3 / 100
    assert tp["has_temporal"] is False
    assert tp["duplicate_rows"] == 0
    assert tp["quality_score"] == 1.0


def test_profile_counts_against_python(spark):
    rows = [(1, "a", None), (2, "b", 1.5), (2, None, 1.5), (3, "a", 2.5), (None, "a", None)]
    df = spark.createDataFrame(rows, "k long, s string, d double")
    got = {r["column_name"]: r for r in P.column_profile(df, "t").collect()}
    for i, name in enumerate(["k", "s", "d"]):
        vals = [r[i] for r in rows]
        nn = [v for v in vals if v is not None]
        assert got[name]["row_count"] == len(vals)
        assert got[name]["null_count"] == len(vals) - len(nn)
        assert got[name]["distinct_count"] == len(set(nn))
    assert got["k"]["min_num"] == 1.0 and got["k"]["max_num"] == 3.0
    assert got["s"]["min_value"] == "a" and got["s"]["byte_size"] == 4


def test_approx_distinct_close(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    exact = {r["column_name"]: r["distinct_count"] for r in P.column_profile(li, "l").collect()}
    approx = {r["column_name"]: r["distinct_count"]
              for r in P.column_profile(li, "l", distinct="approx").collect()}
    for c, e in exact.items():
        assert abs(approx[c] - e) <= max(2, 0.1 * e), c


def test_duplicates_exact(spark):
    rows = [(1, "x"), (1, "x"), (1, "x"), (2, "y"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a long, b string")
    assert P.duplicate_rows(df, "t").first()["duplicate_rows"] == 3


def test_entrepreneurs_json_flags(spark):
    """F2 (3 records, 18 fields) in intended mode."""
    # The field names of the format. All data are made up.
    names = ["date_exec", "code_form_ind_entrep", "name_form_ind_entrep", "inf_surname_ind_entrep_sex", "citizenship_kind",
             "inf_authority_reg_ind_entrep_name", "inf_authority_reg_ind_entrep_code", "inf_reg_tax_ind_entrep", "inf_okved_code",
             "inf_okved_name", "process_dttm", "error_code", "inf_surname_ind_entrep_firstname", "inf_surname_ind_entrep_surname",
             "inf_surname_ind_entrep_midname", "dob", "date_ogrnip", "id_card"]
    # end of fixed values
    recs = []
    for i in range(3):
        r = dict.fromkeys(names, "abc")
        r |= {"error_code": 0, "date_exec": "2021-03-04", "process_dttm": "2021-03-05T01:02:03.004+01:00", "dob": f"1991-07-1{i}",
              "date_ogrnip": "2020-01-02", "inf_authority_reg_ind_entrep_code": "1234", "inf_okved_code": "99.88.7", "id_card": f"AB {i}"}
        recs.append(r)
    df = spark.createDataFrame(recs)
    cp = P.column_profile(df, "ip")
    tp = P.table_profile(cp, None).first()
    assert tp["record_count"] == 3 and tp["field_count"] == 18
    assert tp["has_temporal"] and tp["has_numeric"] and tp["has_text"]
    assert tp["has_categorical"] is True and tp["has_nested"] is False
    assert "id_card" in tp["unique_ids"]
    flags = {r["column_name"]: r for r in P.column_flags(cp).collect()}
    assert flags["dob"]["is_temporal"] and flags["process_dttm"]["is_temporal"]
    assert not flags["inf_authority_reg_ind_entrep_code"]["is_temporal"]   # four digits are not a year
    assert not flags["inf_okved_code"]["is_temporal"]


def test_nested_struct_leaves(spark):
    df = spark.createDataFrame([((1, "a"), [1.0, 2.0])], "s struct<x:int,y:string>, arr array<float>")
    cp = {r["column_name"]: r for r in P.column_profile(df, "n").collect()}
    assert set(cp) == {"s.x", "s.y", "arr"}
    assert cp["s.x"]["from_struct"] and cp["arr"]["kind"] == "nested"
    assert cp["arr"]["byte_size"] == 8
    assert P.table_profile(P.column_profile(df, "n"), None).first()["has_nested"]


@pytest.mark.parametrize("table", ["orders", "events", "documents", "embeddings"])
def test_properties(spark, table):
    df = spark.read.parquet(f"{SF001}/{table}.parquet")
    cp = P.column_profile(df, table)
    for r in cp.collect():
        assert r["distinct_count"] <= r["row_count"] - r["null_count"]
    tp = P.table_profile(cp, P.duplicate_rows(df, table)).first()
    assert 0.0 <= tp["quality_score"] <= 1.0
    assert 0.0 < tp["compression_ratio"] <= 1.0


def test_union_of_parts_merges(spark):
    od = spark.read.parquet(f"{SF001}/orders.parquet")
    a, b = od.where("o_orderkey % 2 = 0"), od.where("o_orderkey % 2 = 1")
    whole = {r["column_name"]: r for r in P.column_profile(od, "o").collect()}
    pa = {r["column_name"]: r for r in P.column_profile(a, "o").collect()}
    pb = {r["column_name"]: r for r in P.column_profile(b, "o").collect()}
    for c, w in whole.items():
        assert w["row_count"] == pa[c]["row_count"] + pb[c]["row_count"]
        if w["min_num"] is not None:
            assert w["min_num"] == min(pa[c]["min_num"], pb[c]["min_num"])
            assert w["max_num"] == max(pa[c]["max_num"], pb[c]["max_num"])


def test_observed_range_uses_epoch_nanoseconds(spark):
    """Q3: in observed mode a leading integer column gives a 1970 range."""
    import datetime as dt
    df = spark.createDataFrame([(1000, "2024-01-02"), (5000, "2024-03-04")], "id long, day string")
    cp = P.column_profile(df, "t")
    obs = P.table_profile(cp, None, mode="observed").first()
    assert obs["ts_min"] == dt.datetime(1970, 1, 1, 0, 0, 0, 1)
    assert obs["ts_max"] == dt.datetime(1970, 1, 1, 0, 0, 0, 5)
    intended = P.table_profile(cp, None).first()
    assert intended["ts_min"] == dt.datetime(2024, 1, 2)


def test_empty_table_keeps_its_columns(spark):
    df = spark.createDataFrame([], "a long, s string, m map<string,int>")
    for mode in ("exact", "approx", "auto", "none"):
        rows = P.column_profile(df, "e", mode).orderBy("ordinal").collect()
        assert [(r["column_name"], r["row_count"], r["null_count"]) for r in rows] == [("a", 0, 0), ("s", 0, 0), ("m", 0, 0)]
    tp = P.table_profile(P.column_profile(df, "e"), P.duplicate_rows(df, "e"))
    from tablesense.operators import checks as C
    assert tp.first()["record_count"] == 0
    assert [tuple(r) for r in C.quality_checks(tp).collect()] == [("e", "error", "empty", "DataFrame is empty")]


def test_decimals_maps_variants_and_intervals(spark):
    df = spark.sql("""
      SELECT * FROM VALUES
        (CAST('9007199254740992' AS DECIMAL(20,0)), map('a', 1, 'b', 2), parse_json('{"x": 1, "y": 2}'), INTERVAL '1' DAY),
        (CAST('9007199254740993' AS DECIMAL(20,0)), map('b', 2, 'a', 1), parse_json('{"y": 2, "x": 1}'), INTERVAL '1' DAY),
        (CAST('9007199254740993' AS DECIMAL(20,0)), map('a', 1, 'b', 3), parse_json('{"y": 2, "x": 1}'), INTERVAL '2' DAY),
        (CAST('9007199254740993' AS DECIMAL(20,0)), map('b', 2, 'a', 1), parse_json('{"x": 1, "y": 2}'), INTERVAL '1' DAY)
        AS t(d, m, v, i)""")
    got = {r["column_name"]: r["distinct_count"] for r in P.column_profile(df, "t").collect()}
    assert got == {"d": 2, "m": 2, "v": 1, "i": 2}
    assert P.duplicate_rows(df, "t").first()["duplicate_rows"] == 1
    from tablesense.operators import store as S
    assert S.fingerprints({"t": df}).count() == 1
    assert S.fingerprints({"t": df}).first() == S.fingerprints({"t": df.repartition(3)}).first()


def test_date_forms_and_offsets(spark):
    import datetime as dt
    df = spark.createDataFrame([("31.01.2024", "2024/01/31", "2024-01-01T10:00:00+03:00", "2024-01-01", "5800"),
                                ("01.02.2024 10:30", "2024/02/01", "2024-01-01T08:00:00Z", "01.01.2024", "99")],
                               "dot string, slash string, off string, two string, num string")
    got = {r["column_name"]: r for r in P.column_profile(df, "t").collect()}
    assert [c for c, r in got.items() if r["timestamp_ok"]] == ["dot", "slash", "off"]
    assert got["dot"]["ts_max"] == dt.datetime(2024, 2, 1, 10, 30)
    assert (got["off"]["ts_min"], got["off"]["ts_max"]) == (dt.datetime(2024, 1, 1, 7), dt.datetime(2024, 1, 1, 8))


def test_date_forms_are_decided_by_the_column(spark):
    import datetime as dt
    cols = {"us": ["01/31/2024", "02/03/2024"], "eu": ["31/01/2024 10:05", "02/03/2024"], "either": ["01/02/2024", "03/04/2024"], "neither": ["01/31/2024", "31/01/2024"],
            "dash": ["28-2-2024", "1-2-2024"], "name": ["Jan 31, 2024", "1 february 2024"], "none": ["Jan 32, 2024", "Marc 3, 2024"], "bad": ["02/30/2024", "30/02/2024"]}
    df = spark.createDataFrame([(*r, None) for r in zip(*cols.values(), strict=True)] + [(None,) * 9], ", ".join(f"{c} string" for c in [*cols, "gone"]))
    got = {r["column_name"]: r for r in P.column_flags(P.column_profile(df, "t", "none")).collect()}
    assert {c: r["date_form"] for c, r in got.items()} == {
        "us": "m/d/y", "eu": "d/m/y", "either": "m/d/y or d/m/y", "neither": None, "dash": "d-m-y", "name": "month name", "none": None, "bad": None, "gone": None}
    assert got["us"]["ts_max"] == dt.datetime(2024, 2, 3) and got["eu"]["ts_max"] == dt.datetime(2024, 3, 2) and got["eu"]["ts_min"] == dt.datetime(2024, 1, 31, 10, 5)
    assert got["either"]["ts_max"] == dt.datetime(2024, 3, 4) and got["dash"]["ts_min"] == dt.datetime(2024, 2, 1) and got["name"]["ts_max"] == dt.datetime(2024, 2, 1)


def test_parts_agree_on_a_date_form(spark):
    """A part whose values fit both readings follows one whose values do not."""
    import datetime as dt
    from tablesense.streaming.jobs import merge_profiles
    parts = [["01/02/2024", "05/04/2024"], ["31/12/2023"], [None]]
    cps = [P.column_profile(spark.createDataFrame([(v,) for v in p], "d string"), "t", "sketch") for p in parts]
    r = merge_profiles(cps[0].unionByName(cps[1]).unionByName(cps[2])).first()
    assert r["timestamp_ok"] and (r["ts_min"], r["ts_max"]) == (dt.datetime(2023, 12, 31), dt.datetime(2024, 4, 5))
    us = P.column_profile(spark.createDataFrame([("12/31/2023",)], "d string"), "t", "sketch")
    assert not merge_profiles(cps[0].unionByName(cps[1]).unionByName(us)).first()["timestamp_ok"]


def test_auto_counts_decide_like_exact_ones(spark):
    """On tables too large for the small-table way: every flag is the same."""
    n = 40_000
    df = spark.range(n).selectExpr("id", "CAST(id AS STRING) AS key", "id DIV 2 AS half", "CAST(id % 4000 AS STRING) AS tenth",
                                   "CAST(id % 3 AS STRING) AS few", "CASE WHEN id = 5 THEN 4 ELSE id END AS almost")
    a, b = (P.column_flags(P.column_profile(df, "t", m)).select("column_name", "is_unique_id", "is_categorical", "narrowed").orderBy("ordinal").collect()
            for m in ("exact", "auto"))
    assert a == b and [r["column_name"] for r in a if r["is_unique_id"]] == ["id", "key"]


def test_profile_shuffles_no_values(spark):
    """Before the exchanges of the exact counts stand hashes only."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = P.exact_distinct({"d": docs})._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange" in line:
            assert "text" not in line
