"""Readers and flattening: F1 CSV with ';', F4-like truncated XML, F8 edges."""

import os

from pyspark.sql import functions as F

from tablesense.sources import files as FL
from tablesense.sources import flatten as FT
from tablesense.sources import readers as RD


def _write(path, name, text, encoding="utf-8"):
    os.makedirs(path, exist_ok=True)
    p = os.path.join(path, name)
    with open(p, "w", encoding=encoding) as f:
        f.write(text)
    return p


def test_csv_semicolon_detected(spark, tmp_dir):
    p = _write(tmp_dir, "tickets.csv", "id;code;name\n1;061001;a\n2;5800;b\n")
    d = RD.detect_csv(spark, p).first()
    assert (d["sep"], d["encoding"], d["multiline"]) == (";", "utf-8", False)
    rows = RD.read_csv(spark, p).collect()
    assert [r["code"] for r in rows] == ["061001", "5800"]   # zeros kept


def test_csv_encodings_read_back(spark, tmp_dir):
    """All bytes decide: a letter across byte 65,536, and cp1251 or latin1 after
    thousands of ASCII lines."""
    wide = "a;b\n" + "x" * 65531 + "\u0416;1\n" + "\u044f;2\n" * 3000
    late = "a,\u0438\u043c\u044f\n" + "1,x\n" * 6000 + "2,\u0418\u0432\u0430\u043d\n"
    for name, text, enc in (("w.csv", wide, "utf-8"), ("r.csv", late, "cp1251")):
        p = _write(f"{tmp_dir}/{enc}", name, text, encoding=enc)
        assert RD.detect_csv(spark, p).first()["encoding"] == enc
        got = RD.read_csv(spark, p).drop(RD.CORRUPT)
        lines = text.strip().split("\n")
        sep = ";" if enc == "utf-8" else ","
        assert got.columns == lines[0].split(sep)
        assert sorted(sep.join(r) for r in got.collect()) == sorted(lines[1:])
    p = f"{tmp_dir}/l.csv"
    with open(p, "wb") as f:
        f.write("a|b\n1|\u00e9\x98\n".encode("latin1"))
    assert RD.read_csv(spark, p).first()["b"] == "\u00e9\x98"


def test_csv_quotes_line_breaks_and_extra_fields(spark, tmp_dir):
    p = _write(tmp_dir, "q.csv", '"a,b";c\n"x ""y"" z";"two\nlines"\n1;2;3\n4\n')
    df = RD.read_csv(spark, p)
    assert df.columns == ["a,b", "c", RD.CORRUPT]
    rows = df.collect()
    assert (rows[0]["a,b"], rows[0]["c"]) == ('x "y" z', "two\nlines")
    c = RD.corrupt_count(df).first()
    assert (c["records"], c["corrupt"]) == (3, 2)


def test_files_that_differ_are_read_apart(spark, tmp_dir):
    _write(tmp_dir, "1.csv", "a;b\n1;2\n")
    _write(tmp_dir, "2.csv", "b,a\n\u0438,4\n", encoding="cp1251")
    got = RD.read_csv(spark, tmp_dir).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [("1", "2"), ("4", "\u0438")]


def test_files_whose_headers_differ_are_united_by_name(spark, tmp_dir):
    for name, text in (("1.csv", "a;b\n1;2\n"), ("2.csv", "b;a\n4;3\n"), ("3.csv", "a;b\n5;6\n"), ("4.csv", "\nc;b;a\n9;8;7\n")):
        _write(f"{tmp_dir}/plain", name, text)
    for name, text in (("1.csv", 'z;"x\ny"\n2;1\n'), ("2.csv", 'z;"x\nz"\n4;3\n')):
        _write(f"{tmp_dir}/breaks", name, text)
    for given in ({}, {"sep": ";", "encoding": "utf-8"}):
        got = RD.read_csv(spark, f"{tmp_dir}/plain", **given)
        rows = sorted((tuple(r) for r in got.select("a", "b", "c", RD.CORRUPT).collect()), key=str)
        assert rows == [("1", "2", None, None), ("3", "4", None, None), ("5", "6", None, None), ("7", "8", "9", None)]
    got = RD.read_csv(spark, f"{tmp_dir}/breaks").drop(RD.CORRUPT)
    assert sorted((r["x\ny"] or "", r["x\nz"] or "", r["z"]) for r in got.collect()) == [("", "3", "4"), ("1", "", "2")]


def test_corrupt_lines_are_written_in_parallel_with_a_header_each(spark, tmp_dir):
    from tablesense.plans.q_ingest import _write_lines
    lines = spark.range(0, 40, 1, 4).select(F.concat("id", F.lit(';"x'), F.when(F.col("id") % 7 == 0, ";e").otherwise(";"), F.lit('"')).alias("a;b"))
    _write_lines(lines, tmp_dir)
    texts = [open(f"{tmp_dir.removeprefix('file:')}/{f}").read().splitlines() for f in os.listdir(tmp_dir.removeprefix("file:")) if f.endswith(".csv")]
    assert len(texts) == 4 and all(x[0] == "a;b" for x in texts)
    assert sorted(y for x in texts for y in x[1:]) == sorted(r[0] for r in lines.collect())
    lines = spark.range(0, 40, 1, 4).select(F.concat("id", F.lit(";x"), F.when(F.col("id") % 7 == 0, ";e").otherwise("")).alias("a;b"))
    _write_lines(lines, f"{tmp_dir}/more")
    c = RD.corrupt_count(RD.read_csv(spark, f"{tmp_dir}/more")).first()
    assert (c["records"], c["corrupt"]) == (40, 6)


def test_admission_reads_sizes_and_first_lines(spark, tmp_dir):
    _write(tmp_dir, "a.csv", "a;b\n1;2\n")
    _write(tmp_dir, "b.csv", "")
    _write(tmp_dir, "c.csv", "x" * 70_000 + ";y\n1;2\n")
    _write(tmp_dir, "d.csv", "no separator\n")
    got = {r["path"][-5:]: r for r in FL.admission(spark, tmp_dir, "csv").collect()}
    assert got["a.csv"]["admitted"] and got["c.csv"]["admitted"]
    assert got["b.csv"]["violations"] == ["empty file", "bad first line"]
    assert got["d.csv"]["violations"] == ["bad first line"]


def test_xml_truncated_file(spark, tmp_dir):
    items = "".join(f"<item><object_common_data><cad_number>0610010090{i:02d}</cad_number>"
                    f"</object_common_data><metadata><status>actual</status></metadata>"
                    f"<coordinates>55.7, 37.{i}</coordinates></item>" for i in range(5))
    p = _write(tmp_dir, "cad.xml", "<root>" + items + "<item><params><material>")
    df = RD.read_xml(spark, p, "item")
    good = RD.without_corrupt(df)
    assert len(good.collect()) == 5
    counts = RD.corrupt_count(df).first()
    assert (counts["records"], counts["corrupt"]) == (6, 1)
    cad = RD.cadastral_projection(good).collect()
    assert sorted(r["cad_number"] for r in cad)[0] == "061001009000"
    xy = RD.split_coordinates(good).collect()
    assert all(r["latitude"] == "55.7" for r in xy)


def test_xml_query_counts_broken_items(spark):
    from tablesense.plans.catalog import load
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    n = load(spark, sf, "orders").count()
    r = E.queries()["xml_corrupt_counts"](spark, sf).first()
    assert (r["records"], r["corrupt"], r["kept"]) == (n + 9, 3, n + 6)


def test_coordinates_not_a_pair(spark):
    df = spark.createDataFrame([("POINT 1",), ("55.7, 37.6",)], "coordinates string")
    out = {r["coordinates"]: r for r in RD.split_coordinates(df).collect()}
    assert out["POINT 1"]["coordinates_raw"] == "POINT 1" and out["POINT 1"]["latitude"] is None
    assert out["55.7, 37.6"]["longitude"] == "37.6"


def test_tag_discovery_counts_within_a_document(spark):
    doc = "<catalog>" + "".join(f"<rec><v>{i}</v></rec>" for i in range(11)) + "</catalog>"
    few = "<rec>" + "<v>1</v>" * 6 + "</rec>"
    df = spark.createDataFrame([(1, doc), (2, few), (3, few)], "id long, html string")
    tags = {(r["id"], r["tag"]): r["count"] for r in RD.tag_discovery(df, "id", "html").collect()}
    assert tags == {(1, "rec"): 11, (1, "v"): 11}


def test_list_policy_keeps_all_elements(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [(1,), (2,), (3,)]), (2, [], None)], "k long, w array<string>, s array<struct<n:int>>")
    words = FT.list_policy(df, ["k"], "w").collect()
    assert [tuple(r) for r in words] == [(1, 0, "a", "a"), (1, 1, "b", "b"), (1, 2, "c", "c"), (2, None, None, None)]
    assert [r["json"] for r in FT.list_policy(df, ["k"], "s").collect()] == ['{"n":1}', '{"n":2}', '{"n":3}', None]


def test_fields_are_found_in_arrays_and_document_order(spark):
    df = spark.createDataFrame([([(None,), ("7",)], ("8",))], "parts array<struct<cad_number:string>>, late struct<cad_number:string>")
    assert RD.cadastral_projection(df).first()["cad_number"] == "7"  # of the first element that has it
    df = spark.createDataFrame([([None, ("7",)], ("8",))], df.schema)
    assert RD.cadastral_projection(df).first()["cad_number"] == "7"


def test_flatten_all_and_json_columns(spark):
    df = spark.createDataFrame([(1, [([1, 2],), ([],)])], "k long, a array<struct<b:array<int>>>")
    got = FT.flatten_all(df)
    assert got.columns == ["k", "a_index", "a_b"] and [tuple(r) for r in got.collect()] == [(1, 0, [1, 2]), (1, 1, [])]
    from tablesense.operators import profile as P
    df = spark.createDataFrame([('{"a": 1}', "[x", "plain"), (" [1, 2]", "y", "{")], "j string, k string, l string")
    assert FT.json_columns(df, P.column_profile(df, "t", "none"), "t") == ["j"]


def test_json_arrays_and_objects(spark, tmp_dir):
    p = _write(tmp_dir, "a.json", '[{"id": 1, "tags": ["a", "b"], "geo": {"lat": 1.5}},'
                                   ' {"id": 2, "tags": [], "geo": {"lat": 2.5}}]')
    df = RD.read_json(spark, p, multiline=True)
    flat = FT.flatten_structs(df)
    assert set(flat.columns) == {"id", "tags", "geo.lat"}
    rows = FT.explode_array(df, ["id"], "tags").collect()
    assert [(r["id"], r["pos"], r["value"]) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (2, None, None)]


def test_json_string_expand(spark):
    df = spark.createDataFrame([(1, '{"k": 5, "n": "x"}'), (2, '{"k": 7}')], "id long, props string")
    out = FT.expand_json_string(df, "props").orderBy("id").collect()
    assert [(r["props_k"], r["props_n"]) for r in out] == [(5, "x"), (7, None)]


def test_format_detect_and_first_line(spark):
    df = spark.createDataFrame([("a/b.CSV",), ("x.jsonl",), ("my_data_file",), ("feed_xml",),
                                ("f.bin",)], "path string")
    got = [r[0] for r in df.select(FL.detect_format(F.col("path"))).collect()]
    assert got == ["csv", "json", "csv", "xml", "unknown"]
    chk = spark.createDataFrame([("csv", "a;b"), ("csv", "ab"), ("json", " [1]"), ("xml", "x")],
                                "f string, l string")
    assert [r[0] for r in chk.select(FL.first_line_ok(F.col("f"), F.col("l"))).collect()] == \
        [True, False, True, False]


def test_fields_that_move_from_record_to_record(spark):
    rows = [((1.5, None), None, None), (None, ("2", None), None), (None, None, [(None,), ("3",), ("4",)]), (None, None, [])]
    df = spark.createDataFrame(rows, "p struct<area:double, status:string>, q struct<area:string, status:string>, r array<struct<area:string>>")
    got = RD.cadastral_projection(df).collect()
    assert [(r["area"], r["area_text"]) for r in got] == [(1.5, "1.5"), (2.0, "2"), (3.0, "3"), (None, None)]
    df = spark.createDataFrame([("", ("x", ["", "1, 2"])), (None, (None, None))], "coordinates string, location struct<_VALUE:string, coord:array<string>>")
    got = RD.split_coordinates(df).collect()
    assert [(r["latitude"], r["coordinates_raw"]) for r in got] == [(None, "x"), (None, None)]  # '' counts as absent; 'coord' begins with ''
    df = spark.createDataFrame([(("x", [None, "1, 2"]),)], "location struct<_VALUE:string, coord:array<string>>")
    assert RD.split_coordinates(df).first()["longitude"] == "2"


def test_sibling_arrays_do_not_multiply(spark):
    df = spark.createDataFrame([(1, [(i,) for i in range(4)], [("a", [(j,) for j in range(i)]) for i in range(5)], [7, 8]), (2, None, [], None)],
                               "k long, a array<struct<x:int>>, b array<struct<y:string, c:array<struct<z:int>>>>, l array<int>")
    got = FT.flatten_all(df)
    assert got.columns == ["k", "l", "a_index", "a_x", "b_index", "b_y", "b_c_index", "b_c_z"]
    rows = [tuple(r) for r in got.collect()]
    one = [r[2:] for r in rows if r[0] == 1]
    assert sorted(r for r in one if r[0] is not None) == [(i, i, None, None, None, None) for i in range(4)]
    b = [r for r in one if r[2] is not None]
    assert len(one) == 4 + 1 + 1 + 2 + 3 + 4 and sorted(b, key=str) == sorted(
        [(None, None, 0, "a", None, None)] + [(None, None, i, "a", j, j) for i in range(5) for j in range(i)], key=str)
    assert [r for r in rows if r[0] == 2] == [(2, None, None, None, None, None, None, None)]
    assert all(r[1] == [7, 8] for r in rows if r[0] == 1)


def test_archive_keeps_days_and_batches(spark, tmp_dir):
    from tablesense.sources import sinks as SK
    path = f"{tmp_dir}/archive"
    put = lambda rows, batch: SK.archive_partitioned(spark.createDataFrame(rows, "ts string, v int").selectExpr("try_cast(ts AS timestamp) AS ts", "v"), "ts", path, batch)
    put([("2024-01-01", 1), ("2024-01-03", 3), (None, 9)], "a*1")
    put([("2024-01-02", 2), ("2024-01-01", 4)], "b")
    put([("2024-01-02", 5)], "a*2")
    read = lambda: sorted((r["day"] or 0, r["batch"], r["v"]) for r in spark.read.parquet(path).collect())
    assert read() == [(0, "a*1", 9), (1, "a*1", 1), (1, "b", 4), (2, "a*2", 5), (2, "b", 2), (3, "a*1", 3)]
    put([("2024-01-02", 2), ("2024-01-01", 4)], "b")  # again
    assert len(read()) == 6
    put([("2024-01-01", 1), ("2024-01-04", 6)], "a*1")  # again, corrected
    assert read() == [(1, "a*1", 1), (1, "b", 4), (2, "a*2", 5), (2, "b", 2), (4, "a*1", 6)]


def test_first_lines_sort_no_lines_and_keep_their_order(spark, tmp_dir):
    """Files of several blocks, of one line, and many in one task."""
    _write(tmp_dir, "a.csv", "z;first\n" + "".join(f"{i};a\n" for i in range(60_000)))
    _write(tmp_dir, "b.csv", "\nsecond\n")
    for i in range(30):
        _write(tmp_dir, f"c{i:02d}.csv", f"{99 - i};c\nnext\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = FL.first_lines(spark, tmp_dir)
        got = {r.path[-7:].lstrip("/").split("/")[-1]: r.first_line for r in df.collect()}
        assert df.count() == 32 and got["a.csv"] == "z;first" and got["b.csv"] == ""
        assert all(got[f"c{i:02d}.csv"] == f"{99 - i};c" for i in range(30))
        assert "Sort" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
