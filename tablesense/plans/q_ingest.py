"""Ingest queries.

Each query writes data derived from the driver's tables in the format under
test into the shared checkpoint folder, reads it back through the readers
of ``tablesense.sources`` and returns what they see; the oracle is the
plain SELECT of the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.operators import profile as P
from tablesense.sources import files as FL
from tablesense.sources import flatten as FT
from tablesense.sources import readers as RD
from tablesense.sources import sinks as SK
from tablesense.plans.catalog import load
from tablesense.plans.registry import dec, query
from tablesense.session import scratch_path

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
ORDER_TEXT_SQL = ("CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
                  "o_orderstatus, o_orderpriority")


# One input per encoding: a text column whose letters the encoding has, quotes,
# separators and line breaks inside fields, and a header name that needs quotes.
CSV_INPUTS = {"utf-8": (";", "ж€"), "cp1251": (",", "жЯ"), "latin1": ("|", "é\x98")}
CSV_SQL = "\nUNION ALL\n".join(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '{mark}' || CASE WHEN o_orderkey % 10 = 0 THEN 'x "y"{sep} z' WHEN o_orderkey % 10 = 1
  THEN 'two' || chr(10) || 'lines' ELSE o_orderpriority END AS "note{sep}1", CAST(NULL AS VARCHAR) AS corrupt, '{sep}' AS sep, '{enc}' AS encoding FROM orders"""
    .replace('"note' + sep + '1"', "note").replace("'é\x98'", "'é' || chr(152)") for enc, (sep, mark) in CSV_INPUTS.items())


def _write_csv(df, path: str, sep: str, enc: str) -> None:
    """Spark writes UTF-8 or latin1; a cp1251 file is the latin1 file of the
    characters numbered as its bytes."""
    if enc == "cp1251":
        chars = [(bytes([b]).decode("cp1251", "ignore"), chr(b)) for b in range(128, 256)]
        new, old = ("".join(x) for x in zip(*[c for c in chars if c[0]], strict=True))
        df = df.select(*[F.translate(F.col(f"`{c}`"), new, old).alias(c) for c in df.columns])
    (df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
       .option("encoding", "UTF-8" if enc == "utf-8" else "ISO-8859-1").csv(path))


@query("csv_scan_detect", sql=CSV_SQL)
def q_csv_scan_detect(spark, sf_dir):
    """Three inputs written in their encodings, each detected and read back."""
    od, parts, base = load(spark, sf_dir, "orders"), [], scratch_path(spark, "orders-csv")
    for enc, (sep, mark) in CSV_INPUTS.items():
        path, k = f"{base}/{enc}", F.col("o_orderkey") % 10
        note = F.when(k == 0, F.lit(f'x "y"{sep} z')).when(k == 1, F.lit("two\nlines")).otherwise(F.col("o_orderpriority"))
        _write_csv(od.select(F.col("o_orderkey").cast("string"), F.concat(F.lit(mark), note).alias(f"note{sep}1")), path, sep, enc)
        found = RD.detect_csv(spark, path).groupBy("sep", "encoding").agg(F.count(F.lit(1)).alias("files"))
        kind = found.orderBy(F.col("files").desc()).first()  # small files without a marked row look alike
        got = RD.read_csv(spark, path)
        parts.append(got.select("o_orderkey", F.col(f"`note{sep}1`").alias("note"), F.col(RD.CORRUPT).alias("corrupt"),
                                F.lit(kind["sep"]).alias("sep"), F.lit(kind["encoding"]).alias("encoding")))
    return reduce(DataFrame.unionByName, parts)


def _write_lines(lines: DataFrame, path: str) -> None:
    """Lines of text, the only column, as they are; its name heads every file."""
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)


@query("corrupt_counts", sql="""
SELECT 'csv' AS format, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (WHERE o_orderkey % 7 = 0) AS BIGINT) AS corrupt, true AS hashed FROM orders
UNION ALL SELECT 'json', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE o_orderkey % 7 = 0) AS BIGINT), true FROM orders""")
def q_corrupt_counts(spark, sf_dir):
    """Lines with a field too many and cut JSON lines: counted, not dropped in
    silence."""
    od = load(spark, sf_dir, "orders")
    bad, key, base = F.col("o_orderkey") % 7 == 0, F.col("o_orderkey").cast("string"), scratch_path(spark, "broken")
    _write_lines(od.select(F.concat(key, F.lit(";x"), F.when(bad, ";extra").otherwise("")).alias("a;b")), f"{base}/csv")
    od.select(F.concat(F.lit('{"a": '), key, F.when(bad, "").otherwise(', "b": "x"}')).alias("value")).write.text(f"{base}/json")
    reads = {"csv": RD.read_csv(spark, f"{base}/csv"),
             "json": RD.read_json(spark, f"{base}/json", schema=f"a long, b string, {RD.CORRUPT} string")}
    return reduce(DataFrame.unionByName, [RD.corrupt_count(df).select(
        F.lit(f).alias("format"), F.col("records").cast("long").alias("records"), F.col("corrupt").cast("long").alias("corrupt"), (F.length("content_hash") > 0).alias("hashed")) for f, df in reads.items()])


@query("union_parts", sql="""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL BY NAME
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def q_union_parts(spark, sf_dir):
    od = load(spark, sf_dir, "orders")
    a = od.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus",
                                                       "o_orderpriority")
    b = od.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_custkey", "o_orderstatus")
    return a.unionByName(b, allowMissingColumns=True)


@query("json_scan", sql="""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer""")
def q_json_scan(spark, sf_dir):
    path = scratch_path(spark, "customer-json")
    load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                           "c_mktsegment").write.json(path)
    return RD.read_json(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("json_flatten", sql="""
SELECT o_orderkey, o_custkey AS "customer.o_custkey", o_orderstatus AS "customer.detail.status",
  o_orderpriority AS "customer.detail.priority" FROM orders""")
def q_json_flatten(spark, sf_dir):
    path = scratch_path(spark, "orders-nested-json")
    od = load(spark, sf_dir, "orders")
    od.select("o_orderkey", F.struct(
        "o_custkey", F.struct(F.col("o_orderstatus").alias("status"),
                              F.col("o_orderpriority").alias("priority")).alias("detail"))
        .alias("customer")).write.json(path)
    return FT.flatten_structs(RD.read_json(spark, path), ".")


@query("json_string_expand", sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")
def q_json_string_expand(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "props")
    return FT.expand_json_string(ev, "props")


@query("json_string_rows", sql="""
SELECT o_orderkey, CAST(i AS INTEGER) AS a_index, CAST(o_custkey + i AS BIGINT) AS a_c, CASE WHEN i = 0 THEN o_orderstatus END AS a_s
FROM orders, range(0, 2) t(i) WHERE i < o_orderkey % 3
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0""")
def q_json_string_rows(spark, sf_dir):
    """A text column of JSON arrays of objects becomes rows."""
    od = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "to_json(filter(array(named_struct('c', o_custkey, 's', o_orderstatus, 'i', 0), named_struct('c', o_custkey + 1, 's', CAST(NULL AS STRING), 'i', 1)), "
        "x -> x.i < o_orderkey % 3)) AS a")
    return FT.expand_json_string(od, "a").select("o_orderkey", "a_index", "a_c", "a_s")


@query("json_string_map", sql="""
SELECT o_orderkey, 'k' || o_orderkey AS key, o_orderstatus AS value FROM orders""")
def q_json_string_map(spark, sf_dir):
    """A text column of JSON objects whose keys are values becomes a map."""
    od = load(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.create_map(F.concat(F.lit("k"), "o_orderkey"), "o_orderstatus")).alias("a"))
    return FT.expand_json_string(od, "a").select("o_orderkey", F.explode("a").alias("key", "value"))


@query("json_array_scan", sql="""
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer""")
def q_json_array_scan(spark, sf_dir):
    """Customers as JSON arrays of a hundred, several in a file, laid out over
    lines; read by all tasks that have a split."""
    path = scratch_path(spark, "customer-arrays")
    one = F.regexp_replace(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), '","', '",\n  "')
    arrays = load(spark, sf_dir, "customer").groupBy((F.col("c_custkey") / 100).cast("long")).agg(F.collect_list(one).alias("l"))
    arrays.select(F.concat(F.lit("[\n"), F.array_join("l", " ,\n"), F.lit("]"))).write.text(path)
    return RD.read_json(spark, path, multiline=True).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("array_explode", sql="""
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
  unnest(embedding) AS value FROM embeddings""")
def q_array_explode(spark, sf_dir):
    return FT.explode_array(load(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")


@query("inline_rows", sql="""
SELECT o_orderkey, 'price' AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders
UNION ALL
SELECT o_orderkey, 'customer', CAST(o_custkey AS DECIMAL(18,2)) FROM orders""")
def q_inline_rows(spark, sf_dir):
    od = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "array(named_struct('kind', 'price', 'amount', CAST(o_totalprice AS DECIMAL(18,2))), "
        "named_struct('kind', 'customer', 'amount', CAST(o_custkey AS DECIMAL(18,2)))) AS parts")
    return FT.inline_rows(od, ["o_orderkey"], "parts")


@query("path_value", sql="""
SELECT c_custkey, 'c_name' AS path, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""")
def q_path_value(spark, sf_dir):
    return FT.path_value(load(spark, sf_dir, "customer"), ["c_custkey"],
                         ["c_name", "c_mktsegment", "c_nationkey"])


@query("list_policy", sql="""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS index, l[i] AS value, l[i] AS json FROM w, range(1, 100) t(i) WHERE i <= len(l)
UNION ALL SELECT p_partkey, CAST(i AS INTEGER), NULL, '{"n":' || i || '}' FROM part, range(0, 3) t(i)""")
def q_list_policy(spark, sf_dir):
    """All elements of a list of words and of a list of structs."""
    pt = load(spark, sf_dir, "part")
    words = FT.list_policy(pt.select("p_partkey", F.split("p_name", " ").alias("words")), ["p_partkey"], "words")
    structs = pt.select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("n"))).alias("s"))
    return words.unionByName(FT.list_policy(structs, ["p_partkey"], "s"))


@query("flatten_all", sql="""
SELECT o_orderkey, CAST(i AS INTEGER) AS s_index, CAST(i AS INTEGER) AS s_n, CAST(j AS INTEGER) AS s_t_index, CAST(i * 10 + j AS INTEGER) AS s_t_v, o_orderstatus AS h_st,
  CAST(NULL AS INTEGER) AS u_index, CAST(NULL AS VARCHAR) AS u_w FROM orders, range(0, 2) a(i), range(0, 2) b(j)
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, o_orderstatus, CAST(i AS INTEGER), o_orderpriority FROM orders, range(0, 3) c(i)""")
def q_flatten_all(spark, sf_dir):
    """A struct beside arrays of structs within arrays of structs, and an array beside those."""
    od = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "named_struct('st', o_orderstatus) AS h",
        "transform(array(0, 1), i -> named_struct('n', i, 't', transform(array(0, 1), j -> named_struct('v', i * 10 + j)))) AS s",
        "array_repeat(named_struct('w', o_orderpriority), 3) AS u")
    return FT.flatten_all(od)


@query("json_columns", sql="""
SELECT 'events' AS table_name, 'props' AS column_name FROM events HAVING count(*) > 0
UNION ALL SELECT 'orders_json', 'blob' FROM orders HAVING count(*) > 0""")
def q_json_columns(spark, sf_dir):
    """String columns that hold JSON in every row, found, not named."""
    od = load(spark, sf_dir, "orders")
    tables = {"events": load(spark, sf_dir, "events"), "pages": load(spark, sf_dir, "pages"),
              "orders_json": od.select("o_orderkey", F.to_json(F.struct("o_orderstatus")).alias("blob"), F.lit("[not json").alias("open"))}
    cp = P.catalog_column_profile(tables, "none")
    found = [(t, c) for t, df in tables.items() for c in FT.json_columns(df, cp, t)]
    return spark.createDataFrame(found, "table_name string, column_name string")


# --------------------------------------------------------------------------
# XML: cadastral-shaped records derived from customer
# --------------------------------------------------------------------------

def _cadastral_source(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.selectExpr(
        "named_struct('status', c_mktsegment, 'last_container_fixed_at', "
        "concat('2024-01-', lpad(CAST(c_nationkey + 1 AS STRING), 2, '0'), 'T10:00:00+03:00')) "
        "AS metadata",
        "named_struct('cad_number', lpad(CAST(c_custkey AS STRING), 12, '0')) AS object_common_data",
        "c_name AS address",
        "named_struct('coordinates', CASE WHEN c_custkey % 5 = 0 THEN concat('POINT ', "
        "CAST(c_custkey AS STRING)) ELSE concat(CAST(c_nationkey AS STRING), ', ', "
        "CAST(c_custkey % 90 AS STRING)) END) AS location_info",
        "'parcel' AS object_type",
        "named_struct('area', CASE WHEN c_custkey % 3 > 0 THEN CAST(c_acctbal AS STRING) END, 'purpose', "  # every third area elsewhere
        "CASE WHEN c_nationkey % 2 = 0 THEN 'living' ELSE 'office' END) AS params",
        "CASE WHEN c_custkey % 3 = 0 THEN named_struct('land', named_struct('area', CAST(c_acctbal AS STRING))) END AS use",
        "named_struct('ordinate', transform(sequence(0, CAST(c_custkey % 3 + 1 AS INT)), "
        "i -> named_struct('x', c_nationkey, 'y', i))) AS ordinates")


def _cadastral_xml(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "cadastral-xml")
    _cadastral_source(spark, sf_dir).write.format("xml").option("rowTag", "item") \
        .option("rootTag", "root").save(path)
    return RD.without_corrupt(RD.read_xml(spark, path, "item"))


CAD_SQL = """
SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS cad_number, c_mktsegment AS status,
  '2024-01-' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || 'T10:00:00+03:00'
    AS last_container_fixed_at,
  c_name AS address,
  CASE WHEN c_custkey % 5 = 0 THEN 'POINT ' || CAST(c_custkey AS VARCHAR)
       ELSE CAST(c_nationkey AS VARCHAR) || ', ' || CAST(c_custkey % 90 AS VARCHAR) END AS coordinates,
  'parcel' AS object_type, CAST(c_acctbal AS DECIMAL(38,6)) AS area,
  CASE WHEN c_nationkey % 2 = 0 THEN 'living' ELSE 'office' END AS purpose
FROM customer"""


@query("xml_scan", sql=f"SELECT {ORDER_TEXT_SQL} FROM orders")
def q_xml_scan(spark, sf_dir):
    path = scratch_path(spark, "orders-xml")
    load(spark, sf_dir, "orders").select(*ORDER_COLS).write.format("xml") \
        .option("rowTag", "item").option("rootTag", "root").save(path)
    return RD.without_corrupt(RD.read_xml(spark, path, "item")).select(*ORDER_COLS)


@query("xml_corrupt_counts", sql="""
SELECT CAST(count(*) + 9 AS BIGINT) AS records, CAST(3 AS BIGINT) AS corrupt, CAST(count(*) + 6 AS BIGINT) AS kept, true AS hashed FROM orders""")
def q_xml_corrupt_counts(spark, sf_dir):
    """The orders beside three files of two items with a cut one between them:
    what the XML queries leave out (``without_corrupt``) is what is counted."""
    path = scratch_path(spark, "broken-xml")
    load(spark, sf_dir, "orders").select(*ORDER_COLS).write.format("xml") \
        .option("rowTag", "item").option("rootTag", "root").save(path)
    item = "<item>" + "".join(f"<{c}>0</{c}>" for c in ORDER_COLS) + "</item>"
    spark.range(0, 3, 1, 3).select(F.lit(f"<root>{item}<item><o_orderkey>1{item}</root>").alias("value")).write.mode("append").text(path)
    df = RD.read_xml(spark, path, "item")
    return RD.corrupt_count(df).select(
        F.col("records").cast("long").alias("records"), F.col("corrupt").cast("long").alias("corrupt"),
        (F.col("records") - F.col("corrupt")).cast("long").alias("kept"), (F.length("content_hash") > 0).alias("hashed"))


@query("xml_cadastral", sql=CAD_SQL)
def q_xml_cadastral(spark, sf_dir):
    cad = RD.cadastral_projection(_cadastral_xml(spark, sf_dir))
    return cad.withColumn("area", dec("area")).drop("area_text")


@query("coord_split", sql=f"""
SELECT cad_number,
  CASE WHEN contains(coordinates, ',') THEN trim(split_part(coordinates, ',', 1)) END AS latitude,
  CASE WHEN contains(coordinates, ',') THEN trim(split_part(coordinates, ',', 2)) END AS longitude,
  CASE WHEN NOT contains(coordinates, ',') THEN coordinates END AS coordinates_raw
FROM ({CAD_SQL}) c""")
def q_coord_split(spark, sf_dir):
    x = RD.split_coordinates(_cadastral_xml(spark, sf_dir))
    return x.select(F.col("object_common_data.cad_number").alias("cad_number"), "latitude",
                    "longitude", "coordinates_raw")


@query("nested_flatten_rows", sql="""
SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS cad_number, CAST(i AS INTEGER) AS idx,
  CAST(c_nationkey AS VARCHAR) AS x, CAST(i AS VARCHAR) AS y
FROM customer, range(0, c_custkey % 3 + 2) t(i)""")
def q_nested_flatten_rows(spark, sf_dir):
    x = _cadastral_xml(spark, sf_dir).select(
        F.col("object_common_data.cad_number").alias("cad_number"),
        F.col("ordinates.ordinate").alias("ords"))
    rows = FT.explode_array(x, ["cad_number"], "ords")
    return rows.select("cad_number", F.col("pos").cast("int").alias("idx"),
                       F.col("value.x").alias("x"), F.col("value.y").alias("y"))


TAG_RE = "<([A-Za-z][A-Za-z0-9_.:-]*)"


@query("tag_discovery", sql=f"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '{TAG_RE}', 1) AS tags FROM pages),
c AS (SELECT page_id, tags[1] AS root, unnest(tags) AS tag FROM t)
SELECT page_id, tag, CAST(count(*) AS BIGINT) AS count FROM c
WHERE tag <> root GROUP BY page_id, tag HAVING count(*) > 10""")
def q_tag_discovery(spark, sf_dir):
    return RD.tag_discovery(load(spark, sf_dir, "pages"), "page_id", "html").select(
        "page_id", "tag", F.col("count").cast("long"))


def _lines_sql(table: str, col: str) -> str:
    split = f"string_split({col}, chr(10))"
    return (f"SELECT '{table}' AS table_name, CAST(sum(len({split})) AS BIGINT) AS lines, "
            f"CAST(sum(len(list_filter({split}, lambda x: starts_with(x, '{{')))) AS BIGINT) AS brace_lines, "
            f"CAST(sum(len(list_filter({split}, lambda x: contains(x, '<item>')))) AS BIGINT) AS item_lines "
            f"FROM {table}")


@query("structure_counts", sql=_lines_sql("pages", "html") + "\nUNION ALL\n"
       + _lines_sql("conversations", "text"))
def q_structure_counts(spark, sf_dir):
    parts = [FL.structure_counts(load(spark, sf_dir, t), c).select(F.lit(t).alias("table_name"), "*")
             for t, c in [("pages", "html"), ("conversations", "text")]]
    return reduce(DataFrame.unionByName, parts)


@query("format_detect", sql="""
WITH e AS (SELECT page_id, url,
  lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$', 1)) AS ext FROM pages)
SELECT page_id, CASE WHEN ext IN ('.csv', '.txt') THEN 'csv' WHEN ext IN ('.json', '.jsonl') THEN 'json'
  WHEN ext IN ('.xml', '.xsd') THEN 'xml' WHEN regexp_matches(lower(url), 'csv|data') THEN 'csv'
  WHEN contains(lower(url), 'json') THEN 'json' WHEN contains(lower(url), 'xml') THEN 'xml'
  ELSE 'unknown' END AS format
FROM e""")
def q_format_detect(spark, sf_dir):
    pg = load(spark, sf_dir, "pages")
    return pg.select("page_id", FL.detect_format(F.col("url")).alias("format"))


@query("file_admission", sql="""
SELECT * FROM (VALUES ('csv', true, ''), ('json', true, ''), ('xml', true, ''), ('json', false, 'extension does not match format,bad first line'),
  ('csv', false, 'extension does not match format,bad first line')) t(format, admitted, violations)""")
def q_file_admission(spark, sf_dir):
    """The orders as files of each format, and XML files declared otherwise."""
    od = load(spark, sf_dir, "orders").select(*ORDER_COLS)
    base = scratch_path(spark, "admit")
    od.write.option("header", True).option("sep", ";").csv(f"{base}/csv")
    od.write.json(f"{base}/json")
    od.write.format("xml").option("rowTag", "item").option("rootTag", "root").save(f"{base}/xml")
    got = [FL.admission(spark, f"{base}/{folder}/part-*", declared)
           for folder, declared in (("csv", "csv"), ("json", "json"), ("xml", "xml"), ("xml", "json"), ("xml", "csv"))]
    return reduce(DataFrame.unionByName, got).select("format", "admitted", F.array_join("violations", ",").alias("violations")).distinct()


@query("archive_partitioned", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM orders GROUP BY 1, 2, 3""")
def q_archive_partitioned(spark, sf_dir):
    """Three runs: early orders; a batch with late ones of a day in the archive,
    with rows and days that do not belong to it; that batch again, corrected."""
    path, od = scratch_path(spark, "orders-archive"), load(spark, sf_dir, "orders")
    path, od = scratch_path(spark, "orders-archive"), load(spark, sf_dir, "orders")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    late, last = (year == 2000) & (month == 6) & (F.col("o_orderkey") % 3 == 2), year > 2000
    SK.archive_partitioned(od.where(~(last | late) | year.isNull()), "o_orderdate", path, "early", tasks=16)
    SK.archive_partitioned(od.where(last | ((year == 2000) & (month >= 5))), "o_orderdate", path, "rest", tasks=16)
    SK.archive_partitioned(od.where(last | late), "o_orderdate", path, "rest", tasks=16)
    back = spark.read.parquet(path)
    return back.groupBy(*[F.col(c).cast("int").alias(c) for c in ("year", "month", "day")]).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
