"""Struct flattening, JSON-string expansion and array explosion.

All are projections planned from the schema on the driver (no job), except
``json_string_schema``, which infers the schema of JSON text with one
aggregation (``schema_of_variant_agg``: partial per task, merged once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every struct field becomes a top-level column named parent<sep>child
    (json_normalize style with '.', the XML flattener's style with '_').
    Arrays and maps are kept as they are."""
    cols = []

    def walk(dt: T.StructType, path: str, name: str):
        for f in dt.fields:
            p = f"{path}.{_q(f.name)}" if path else _q(f.name)
            n = f"{name}{sep}{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                walk(f.dataType, p, n)
            else:
                cols.append(F.expr(p).alias(n))

    walk(df.schema, "", "")
    return df.select(*cols)


MOST_KEYS = 1_000  # an object column with more different keys is a map, not a struct


def json_string_schema(df: DataFrame, col: str, most_keys: int = MOST_KEYS) -> str | None:
    """DDL schema of the JSON held in a string column, merged over all rows.
    Keys of the outer objects are counted by a sketch first: if there are more than
    ``most_keys`` they are values, and the schema is a map of texts, so it does
    not grow with the data. (Keys of inner objects are not counted.)"""
    text = F.col(_q(col))
    keys = df.select(F.explode(F.json_object_keys(F.when(F.ltrim(text).startswith("{"), text))).alias("k"))
    if keys.agg(F.approx_count_distinct("k", 0.02).alias("n")).first()["n"] > most_keys:
        return "MAP<STRING, STRING>"
    s = df.agg(F.expr(f"schema_of_variant_agg(try_parse_json({_q(col)}))").alias("s")).first()["s"]
    if s is None:
        return None
    return s.replace("OBJECT<", "STRUCT<")


def expand_json_string(df: DataFrame, col: str, schema: str | None = None, sep: str = "_"
                       ) -> DataFrame:
    """A string column of JSON is parsed: of objects the fields become
    columns ``col<sep>field`` next to the other columns, or ``col`` a map if the
    keys are values; of arrays every element is a row, its place in
    ``col<sep>index`` (a text without elements is one row)."""
    schema = schema or json_string_schema(df, col)
    if schema is None:
        return df
    others = [F.col(_q(c)) for c in df.columns if c != col]
    parsed = F.from_json(F.col(_q(col)), schema)
    if schema.startswith("ARRAY<"):
        rows = df.select(*others, F.posexplode_outer(parsed).alias(f"{col}{sep}index", col))
        element = rows.schema[col].dataType
        if not isinstance(element, T.StructType):
            return rows
        return rows.select(*others, F.col(_q(f"{col}{sep}index")), *[F.col(_q(col)).getField(f.name).alias(f"{col}{sep}{f.name}") for f in element.fields])
    if schema.startswith("MAP<"):
        return df.select(*others, parsed.alias(col))
    if not schema.startswith("STRUCT<"):
        return df
    st = T._parse_datatype_string(schema)
    return df.select(*others, *[parsed.getField(f.name).alias(f"{col}{sep}{f.name}")
                                for f in st.fields])


def explode_array(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Arrays become child rows (key, pos, value) with ``posexplode_outer``:
    the index is data, not part of a column name."""
    return df.select(*[F.col(_q(k)) for k in keys],
                     F.posexplode_outer(F.col(_q(col))).alias("pos", "value"))


def inline_rows(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """An array of structs becomes one row per element (``inline_outer``)."""
    return df.select(*[F.col(_q(k)) for k in keys], F.inline_outer(F.col(_q(col))))


def path_value(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Scalar columns become (path, value) rows, values as text."""
    pairs = ", ".join(f"'{c}', CAST({_q(c)} AS STRING)" for c in cols)
    return df.selectExpr(*[_q(k) for k in keys], f"stack({len(cols)}, {pairs}) AS (path, value)")


def list_policy(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Rows (keys, index, value, json) of all elements of a list column.
    Elements that are structs or lists are given as JSON, scalars as values
    too; an empty list gives one row without index."""
    inner = df.schema[col].dataType.elementType
    scalar = not isinstance(inner, (T.StructType, T.ArrayType, T.MapType))
    rows = df.select(*[F.col(_q(k)) for k in keys], F.posexplode_outer(F.col(_q(col))).alias("index", "e"))
    text = F.col("e").cast("string") if scalar else F.to_json("e")
    return rows.select(*[F.col(_q(k)) for k in keys], "index", (text if scalar else F.lit(None).cast("string")).alias("value"), text.alias("json"))


def json_columns(df: DataFrame, profile: DataFrame, table: str) -> list[str]:
    """The string columns of a table whose values all parse as JSON objects
    or arrays; only those that the profile marks as holding '{' or '[' are
    tried, in one aggregation."""
    marked = {r["column_name"] for r in profile.where((F.col("table_name") == table) & F.col("nested_hit")).select("column_name").collect()}
    cols = [c for c in df.columns if c in marked]
    if not cols:
        return []
    ok = lambda c: F.bool_and(F.expr(f"coalesce(ltrim({_q(c)}) RLIKE '^[{{\\\\[]', true) AND ({_q(c)} IS NULL OR try_parse_json({_q(c)}) IS NOT NULL)"))
    row = df.agg(*[ok(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def flatten_all(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs become columns and arrays of structs rows, at any depth,
    until only scalars and lists of scalars are left. Every element of every
    array is one row: arrays that stand side by side do not multiply, a row of
    one has nulls for the others. What stands outside the arrays is repeated.
    ``<column>_index`` keeps the place of each exploded element; a record
    whose arrays are all empty is one row."""
    while True:
        df = flatten_structs(df, sep)
        nested = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType))]
        if not nested:
            return df

        def rows(own: T.StructField):
            """The elements of one array, in its columns; those of the others are null."""
            return F.transform(F.coalesce(F.col(_q(own.name)), F.array().cast(own.dataType)), lambda e, i: F.struct(*[c for f in nested for c in (
                (i if f is own else F.lit(None)).cast("int").alias(f"{f.name}{sep}index"),
                (e if f is own else F.lit(None).cast(f.dataType.elementType)).alias(f.name))]))

        names = {f.name for f in nested}
        df = df.select(*[F.col(_q(c)) for c in df.columns if c not in names], F.inline_outer(F.concat(*[rows(f) for f in nested])))
