"""Records cut by several tasks per file, against plain parsing in Python."""

import contextlib
import csv
import gzip
import io
import json
import os
import random

import pytest

from tablesense.sources import readers as RD
from tablesense.sources import records as RC


@contextlib.contextmanager
def small_splits(spark, size):
    key = "spark.sql.files.maxPartitionBytes"
    before = {k: spark.conf.get(k) for k in (key, "spark.sql.files.openCostInBytes")}
    spark.conf.set(key, str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return f"{folder}/{name}"


def csv_text(seed, rows=60, eol="\n"):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(['a', 'ж', ';', '"', "\n", "\r\n", " ", "xyz" * 9]) for _ in range(r.randint(0, 12)))
    data = [[str(i), cell() + "x", cell() + "y"] for i in range(rows)]
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator=eol, quoting=csv.QUOTE_ALL)
    w.writerows([["id", "a", "b"], *data])
    return out.getvalue(), data


@pytest.mark.parametrize("size", [40, 300, 10_000_000])
def test_quoted_line_breaks_over_splits(spark, tmp_dir, size):
    want = []
    for i, eol in enumerate(("\n", "\r\n", "\r")):
        text, data = csv_text(i, eol=eol)
        if eol == "\r":  # line feeds within fields only
            text, data = text.replace("\r\n", " "), [[c.replace("\r\n", " ") for c in d] for d in data]
        want += data
        write(tmp_dir, f"{i}.csv", text if i else text.rstrip("\n"))
    with small_splits(spark, size):
        df = RD.read_csv(spark, tmp_dir)
        tasks = RC.csv_records(spark, f"{tmp_dir}/0.csv").rdd.getNumPartitions()
        got = df.collect()
    assert (tasks > 10) == (size < 1000)
    assert all(r[RD.CORRUPT] is None for r in got)
    assert sorted([r["id"], r["a"], r["b"]] for r in got) == sorted(want)


def test_open_quote_to_the_end(spark, tmp_dir):
    write(tmp_dir, "a.csv", 'a;b\n1;"x\ny"\n2;"open\nthe rest\n' + "3;4\n" * 30)
    for size in (30, 1_000_000):
        with small_splits(spark, size):
            rows = RD.read_csv(spark, tmp_dir, ).collect()
        assert [r["a"] for r in rows if r["a"] == "1"] == ["1"] and len(rows) == 2


def test_folder_of_empty_files(spark, tmp_dir):
    for i in range(2):
        write(tmp_dir, f"{i}.csv", "")
    assert RD.read_csv(spark, tmp_dir).count() == 0
    write(f"{tmp_dir}/blank", "b.csv", "\n \n")
    assert RD.read_csv(spark, f"{tmp_dir}/blank").count() == 0


def objects(n, seed=1):
    r = random.Random(seed)
    tricky = ['}', '{"', "\\", '\\"}', "]", "[{", "ж", "\n", '"']
    return [{"id": i, "s": "".join(r.choice(tricky) for _ in range(r.randint(0, 8))), "o": {"l": [{"v": r.randint(0, 9)} for _ in range(r.randint(0, 3))]}} for i in range(n)]


@pytest.mark.parametrize("size", [50, 400, 10_000_000])
def test_json_layouts_over_splits(spark, tmp_dir, size):
    layouts = {
        "array": lambda x: json.dumps(x), "pretty": lambda x: json.dumps(x, indent=3) + "\n", "end": lambda x: "".join(json.dumps(o) for o in x),
        "lines": lambda x: "\n".join(json.dumps(o, ensure_ascii=False) for o in x) + "\n", "one": lambda x: " " + json.dumps(x[0], indent=1), "none": lambda x: "[]",
        "bom": lambda x: "\ufeff [\n" + " ,\n".join(json.dumps(o) for o in x) + "]"}
    for i, (name, put) in enumerate(layouts.items()):
        data = objects(40, i)
        folder = f"{tmp_dir}/{name}"
        write(folder, "a.json", put(data))
        with open(f"{folder}/b.json.gz", "wb") as f:
            f.write(gzip.compress(put(data).encode()))
        want = {"one": data[:1], "none": []}.get(name, data) * 2
        with small_splits(spark, size):
            got = RD.read_json(spark, folder, multiline=True, schema=f"id long, s string, o struct<l: array<struct<v: long>>>, {RD.CORRUPT} string").collect()
            if name == "pretty":
                assert (RC.json_records(spark, f"{folder}/a.json").rdd.getNumPartitions() > 10) == (size < 1000)
        key = lambda r: (r["id"], r["s"], [v["v"] for v in r["o"]["l"]])
        assert all(r[RD.CORRUPT] is None for r in got), name
        assert sorted(map(key, got)) == sorted(map(key, want)), name


def test_json_that_is_broken_or_scalar(spark, tmp_dir):
    write(f"{tmp_dir}/x", "a.json", '[{"a": 1}, 7, {"a": 2}, "t", {"a": 3]')
    for size in (8, 1_000_000):
        with small_splits(spark, size):
            rows = RD.read_json(spark, f"{tmp_dir}/x", multiline=True, schema=f"a long, {RD.CORRUPT} string").collect()
        assert sorted(r["a"] for r in rows if r[RD.CORRUPT] is None) == [1, 2]
        assert sorted(r[RD.CORRUPT] for r in rows if r[RD.CORRUPT]) == ['"t"', "7", '{"a": 3]'], size
    write(f"{tmp_dir}/cut", "a.json", '[{"a": 1}, {"a": {"b": 2}')
    rows = RD.read_json(spark, f"{tmp_dir}/cut", multiline=True, schema=f"a string, {RD.CORRUPT} string").collect()
    assert sorted((r["a"] or "", r[RD.CORRUPT] or "") for r in rows) == [("", '{"a": {"b": 2}'), ("1", "")]
    write(f"{tmp_dir}/y", "a.json", " 42\n")
    with pytest.raises(ValueError, match="a.json"):
        RD.read_json(spark, f"{tmp_dir}/y", multiline=True)
    write(f"{tmp_dir}/z", "a.json", "")
    assert RD.read_json(spark, f"{tmp_dir}/z", multiline=True).count() == 0


@pytest.mark.parametrize("size", [37, 200, 10_000_000])
def test_xml_broken_items_cost_no_neighbour(spark, tmp_dir, size):
    """Items cut, crossed, without end or start tag, at any place."""
    good = [f'<item id="{i}"><item_id>{i}</item_id><items>ж</items><p><area>{i}.5</area></p></item>' for i in range(30)] + ["<item/>", '<item id="99" />', "<item><item_id>5</item_id></item >"]
    bad = ["<item><item_id>1</item_id>", "<item><item_id>2</items></item>", "x</item>", "<item><item_id>3</item>", "<item"]
    parts = good[:20]
    for i, b in enumerate(bad[:4]):
        parts.insert(2 + 4 * i, b)
    write(tmp_dir, "a.xml", '<?xml version="1.0"?>\n<root>\n' + "\n".join(parts) + "\n</root>\n")
    write(tmp_dir, "b.xml", "<root>" + "".join(good[20:]))               # ends with an end tag
    write(tmp_dir, "c.xml", "<root>" + good[0] + "<item><item_id>7</item_id>")  # ends within an item
    write(tmp_dir, "d.xml", "<root></root>")
    with small_splits(spark, size):
        df = RD.read_xml(spark, tmp_dir, "item")
        assert (RC.xml_records(spark, f"{tmp_dir}/a.xml", "item").rdd.getNumPartitions() > 4) == (size < 1000)
        c = RD.corrupt_count(df).first()
        ids = sorted(r["item_id"] for r in RD.without_corrupt(df).collect() if r["item_id"] is not None)
    assert (c["records"] - c["corrupt"], c["corrupt"]) == (len(good) + 1, 5)
    assert ids == sorted([str(i) for i in range(30)] + ["0", "5"])


def test_eight_items_the_second_broken(spark, tmp_dir):
    items = [f"<item><v>{i}</v></item>" for i in range(8)]
    items[1] = "<item><v>1</w></item>"
    df = RD.read_xml(spark, write(tmp_dir, "x.xml", "<root>" + "".join(items) + "</root>"), "item")
    c = RD.corrupt_count(df).first()
    assert (c["records"], c["corrupt"]) == (8, 1) and RD.without_corrupt(df).count() == 7


def test_xml_other_encoding(spark, tmp_dir):
    p = write(tmp_dir, "x.xml", '<?xml version="1.0" encoding="windows-1251"?><r><item><v>Жук</v></item></r>'.encode("cp1251"))
    assert RD.read_xml(spark, p, "item", encoding="cp1251").first()["v"] == "Жук"
