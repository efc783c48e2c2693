"""Column and table profiles (A1-A16, P9-P11, P15) by distributed aggregation.

``catalog_column_profile`` is one set of plain aggregates per table; distinct
values are counted by hashes or sketches, never by shuffling values.
``table_profile`` then works on the tiny ``column_profile`` plus a
duplicate-row job that shuffles 8-byte row hashes first and compares whole rows
only for hashes seen more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.functions import names as N
from tablesense.functions import values as V

# ---------------------------------------------------------------------------
# Fixed values from the reference: compression weights and quality bounds.
# ---------------------------------------------------------------------------
WEIGHT_TEXT = 0.3
WEIGHT_WIDE_NUMBER = 0.6
WEIGHT_OTHER = 0.8
CATEGORY_RATIO = 0.5
# end of fixed values

MB = 1024.0 * 1024.0

_KIND = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "float"),
    ((T.BooleanType,), "bool"),
    ((T.TimestampType, T.TimestampNTZType, T.DateType), "timestamp"),
    ((T.StringType, T.VarcharType, T.CharType), "string"),
    ((T.ArrayType, T.MapType, T.StructType, T.VariantType), "nested"),
]
_WIDTH = [
    (T.ByteType, 1), (T.ShortType, 2), (T.IntegerType, 4), (T.LongType, 8),
    (T.FloatType, 4), (T.DoubleType, 8), (T.DecimalType, 16), (T.BooleanType, 1),
    (T.DateType, 4), (T.TimestampType, 8), (T.TimestampNTZType, 8),
]

COLUMN_PROFILE_SCHEMA = (
    "table_name string, ordinal int, column_name string, spark_type string, kind string, "
    "from_struct boolean, row_count long, null_count long, distinct_count long, min_value string, "
    "max_value string, min_num double, max_num double, byte_size long, numeric_hit boolean, "
    "nested_hit boolean, timestamp_ok boolean, ts_min timestamp_ntz, ts_max timestamp_ntz, f32_err double, "
    # of texts: bits of the date forms that all values have, and the range if days come first
    "date_forms int, day_min timestamp_ntz, day_max timestamp_ntz"
)
_FIELDS = [tuple(f.split()) for f in COLUMN_PROFILE_SCHEMA.split(", ")]


def kind_of(dt: T.DataType) -> str:
    for classes, kind in _KIND:
        if isinstance(dt, classes):
            return kind
    return "other"


def width_of(dt: T.DataType) -> int | None:
    for cls, w in _WIDTH:
        if isinstance(dt, cls):
            return w
    return None


def leaf_paths(schema: T.StructType, prefix: str = "", parent: str | None = None,
               depth: int = 0):
    """Depth-first leaves of a schema: (name, SQL path, DataType, from_struct).

    Structs are expanded in place with '.' between names (like a JSON
    normaliser); arrays and maps stay single columns of kind 'nested'.
    """
    for f in schema.fields:
        quoted = "`" + f.name.replace("`", "``") + "`"
        path = quoted if parent is None else f"{parent}.{quoted}"
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType) and len(f.dataType.fields) > 0:
            yield from leaf_paths(f.dataType, name + ".", path, depth + 1)
        else:
            yield name, path, f.dataType, depth > 0


def _orderless(dt: T.DataType) -> bool:
    """Holds a map or variant, whose equal values may differ in form."""
    if isinstance(dt, T.StructType):
        return any(_orderless(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _orderless(dt.elementType)
    return isinstance(dt, (T.MapType, T.VariantType))


def canonical(path: str, dt: T.DataType, depth: int = 0) -> str:
    """SQL of a value that hashes, groups and compares like ``path``: map
    entries as a sorted array of texts, variants as JSON, intervals and other
    types without hash support as text; all else as it is."""
    x = f"x{depth}"
    if isinstance(dt, T.MapType):
        k, v = (f"CAST({canonical(f'{x}.{n}', t, depth + 1)} AS STRING)" if not isinstance(t, (T.StructType, T.ArrayType, T.MapType))
                else f"to_json({canonical(f'{x}.{n}', t, depth + 1)})" for n, t in (("key", dt.keyType), ("value", dt.valueType)))
        return f"array_sort(transform(map_entries({path}), {x} -> named_struct('k', {k}, 'v', {v})))"
    if isinstance(dt, T.VariantType):
        return f"to_json({path})"
    if isinstance(dt, T.ArrayType) and _orderless(dt):
        return f"transform({path}, {x} -> {canonical(x, dt.elementType, depth + 1)})"
    if isinstance(dt, T.StructType) and _orderless(dt):
        fields = ", ".join(f"{_sql_lit(f.name)}, {canonical(f'{path}.`{f.name}`', f.dataType, depth)}" for f in dt.fields)
        return f"CASE WHEN {path} IS NOT NULL THEN named_struct({fields}) END"
    if kind_of(dt) == "other" and not isinstance(dt, T.BinaryType):
        return f"CAST({path} AS STRING)"
    return path


def _sql_lit(v) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


_CHUNK = 8  # columns of one aggregate: its fields stay below the code generation limit
_NONE = {"min_value": "STRING", "max_value": "STRING", "min_num": "DOUBLE", "max_num": "DOUBLE",
         "ts_min": "TIMESTAMP_NTZ", "ts_max": "TIMESTAMP_NTZ", "f32_err": "DOUBLE", "date_forms": "INT", "day_min": "TIMESTAMP_NTZ", "day_max": "TIMESTAMP_NTZ"}
SKETCH_LG = 12  # 1.6 % relative error


def _measures(path: str, dt: T.DataType, distinct: str) -> tuple[dict[str, str], dict[str, str]]:
    """Aggregates over one projected column, and the profile fields made of
    them (``{a}`` stands for the aggregate a)."""
    kind, width = kind_of(dt), width_of(dt)
    agg = {"n": f"count({path})"}
    out = {k: f"CAST(NULL AS {t})" for k, t in _NONE.items()}
    out |= {"numeric_hit": "false", "nested_hit": "false", "timestamp_ok": "false", "distinct_count": "CAST(NULL AS BIGINT)"}
    if distinct in ("approx", "sketch"):
        agg["h"] = f"hll_sketch_agg(xxhash64({canonical(path, dt)}), {SKETCH_LG}) FILTER (WHERE {path} IS NOT NULL)"
        out["distinct_count"] = "coalesce(hll_sketch_estimate({h}), 0)"
        out["sketch"] = "{h}"
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    if kind in ("int", "float"):
        agg |= {"lo": f"min({path})", "hi": f"max({path})",
                "f": f"max(abs(CAST(CAST({path} AS FLOAT) AS DOUBLE) - CAST({path} AS DOUBLE)))"}
        out |= {"min_num": "CAST({lo} AS DOUBLE)", "max_num": "CAST({hi} AS DOUBLE)", "f32_err": "{f}"}
        if kind == "int":
            out |= {"min_value": "CAST({lo} AS STRING)", "max_value": "CAST({hi} AS STRING)"}
    elif kind == "bool":
        agg |= {"lo": f"min({path})", "hi": f"max({path})"}
        out |= {"min_value": "CAST({lo} AS STRING)", "max_value": "CAST({hi} AS STRING)"}
    elif kind == "timestamp":
        agg |= {"lo": f"min({path})", "hi": f"max({path})"}
        lo, hi = "CAST({lo} AS TIMESTAMP_NTZ)", "CAST({hi} AS TIMESTAMP_NTZ)"
        out |= {"min_value": iso.replace("{}", lo), "max_value": iso.replace("{}", hi), "timestamp_ok": "{n} > 0", "ts_min": lo, "ts_max": hi}
    elif kind == "string":
        num = V.NUMERIC_STRING_PATTERN.replace("\\", "\\\\")
        k, a, b = f"k_{path}", f"a_{path}", f"b_{path}"  # of the projections below
        form = V.date_forms_sql(path, k, a, b)
        agg |= {"lo": f"min({path})", "hi": f"max({path})",  # a look at the first character spares most texts the patterns
                "hit": f"bool_or(left({path}, 1) IN ('-', '.', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') AND {path} RLIKE '{num}')",
                "js": f"bool_or(contains({path}, '{{') OR contains({path}, '['))",
                "t0": f"min({a})", "t1": f"max({a})", "d0": f"min(coalesce({b}, {a}))", "d1": f"max(coalesce({b}, {a}))", "f": f"bit_and({form})"}
        out |= {"min_value": "{lo}", "max_value": "{hi}", "numeric_hit": "coalesce({hit}, false)", "nested_hit": "coalesce({js}, false)",
                "timestamp_ok": "{n} > 0 AND {f} <> 0", "date_forms": "{f}", "day_min": "{d0}", "day_max": "{d1}",
                "ts_min": f"if({V.day_first_sql('{f}')}, {{d0}}, {{t0}})", "ts_max": f"if({V.day_first_sql('{f}')}, {{d1}}, {{t1}})"}
    if width is not None:
        out["byte_size"] = f"{{rows}} * {width}"
    elif kind == "string" or isinstance(dt, T.BinaryType):
        agg["b"] = f"sum(octet_length({path}))"
        out["byte_size"] = "coalesce({b}, 0)"
    elif isinstance(dt, T.ArrayType) and width_of(dt.elementType):
        agg["b"] = f"sum(size({path}))"
        out["byte_size"] = f"coalesce({{b}}, 0) * {width_of(dt.elementType)}"
    else:
        text = f"to_json({canonical(path, dt)})" if kind == "nested" and not isinstance(dt, T.VariantType) else f"CAST({canonical(path, dt)} AS STRING)"
        agg["b"] = f"sum(octet_length({text}))"
        out["byte_size"] = "coalesce({b}, 0)"
    return agg, out


def _table_measures(table: str, df: DataFrame, distinct: str) -> list[DataFrame]:
    """Profiles of a table's columns, ``_CHUNK`` of them per plain aggregate."""
    leaves = list(enumerate(leaf_paths(df.schema), 1))
    parts = []
    for lo in range(0, len(leaves), _CHUNK):
        aggs, rows, cols, dates = ["count(1) AS rows"], [], [], ["*"]
        for i, (name, path, dt, from_struct) in leaves[lo:lo + _CHUNK]:
            cols.append(f"{path} AS c{i}")
            if kind_of(dt) == "string":
                cols.append(f"{V.date_kind_sql(path)} AS k_c{i}")
                dates += [f"{V.date_sql(f'c{i}', f'k_c{i}')} AS a_c{i}", f"{V.day_first_date_sql(f'c{i}', f'k_c{i}')} AS b_c{i}"]
            agg, out = _measures(f"c{i}", dt, distinct)
            aggs += [f"{e} AS {k}_{i}" for k, e in agg.items()]
            names = {k: f"{k}_{i}" for k in agg} | {"rows": "rows"}
            f = {"table_name": _sql_lit(table), "ordinal": str(i), "column_name": _sql_lit(name), "spark_type": _sql_lit(dt.simpleString()),
                 "kind": _sql_lit(kind_of(dt)), "from_struct": str(from_struct).lower(), "row_count": "rows", "null_count": f"rows - n_{i}",
                 **{k: e.format(**names) for k, e in out.items()}}
            fields = [*_FIELDS, ("sketch", "binary")] if distinct == "sketch" else _FIELDS
            rows.append("named_struct(" + ", ".join(f"'{k}', CAST({f[k]} AS {t})" for k, t in fields) + ")")
        parts.append(df.selectExpr(*cols).selectExpr(*dates).selectExpr(*aggs).selectExpr("inline(array(" + ", ".join(rows) + "))"))
    return parts


def exact_distinct(tables: dict[str, DataFrame], wanted: dict[str, set[int]] | None = None) -> DataFrame:
    """(table_name, ordinal, exact): distinct non-null values of every column
    (or of the wanted ordinals), by 128-bit hashes. Equal values of a task are
    merged before the shuffle, which never carries a value itself; one job for
    the whole catalog."""
    parts = []
    for no, (table, df) in enumerate(tables.items()):
        cols = [f"named_struct('t', {no}, 'ordinal', {i}, 'a', CASE WHEN {path} IS NOT NULL THEN xxhash64({c}) END, 'b', xxhash64(7, {c}))"
                for i, (_, path, dt, _) in enumerate(leaf_paths(df.schema), 1) if wanted is None or i in wanted.get(table, ())
                for c in [canonical(path, dt)]]
        if cols:
            parts.append(df.selectExpr("inline(array(" + ", ".join(cols) + "))").where("a IS NOT NULL"))
    names = list(tables)
    if not parts:
        return tables[names[0]].sparkSession.createDataFrame([], "table_name string, ordinal int, exact long")
    counts = reduce(DataFrame.union, parts).groupBy("t", "ordinal", "a", "b").agg(F.lit(1)).groupBy("t", "ordinal").agg(F.count(F.lit(1)).alias("exact"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("t") + 1)
    return counts.select(label.alias("table_name"), "ordinal", "exact")


# Ratios of distinct values to rows at which some rule changes its answer; a
# sketch this near (in relative terms) to one is replaced by an exact count.
THRESHOLDS = (0.01, 0.1, 0.5, 0.9, 1.0)
NEAR = 0.1       # six standard errors of the sketch
SMALL_ROWS = 10_000  # tables up to this size are counted exactly


def _needs_exact(rows: int, estimate: int) -> bool:
    return rows <= SMALL_ROWS or any(abs(estimate / rows - t) <= NEAR * t for t in THRESHOLDS)


def catalog_column_profile(tables: dict[str, DataFrame], distinct: str = "exact") -> DataFrame:
    """One row per (flattened) column of every table, empty tables too;
    ``COLUMN_PROFILE_SCHEMA``.

    All measures but distinct counts are plain aggregates, a few columns at a
    time, each scan reading its own columns only; one small row per task is
    shuffled. ``distinct`` says how distinct values are counted:

    * ``exact``: by 128-bit hashes, one shuffle for the whole catalog;
    * ``approx``: by HyperLogLog sketches inside the same aggregates;
    * ``auto``: by sketches, then exactly for the columns whose ratio comes
      near a threshold that rules and designs test. All flags, types and keys
      are those of ``exact``; the counts of the other columns are estimates;
    * ``sketch``: like ``approx``, with the sketch itself as a last column, for
      merging profiles of parts;
    * ``none``: not at all (null).
    """
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    mode = "approx" if distinct == "auto" else distinct
    parts = [p for t, df in tables.items() for p in _table_measures(t, df, mode)]
    if not parts:
        return spark.createDataFrame([], COLUMN_PROFILE_SCHEMA)
    cp = reduce(DataFrame.union, parts)
    if distinct in ("approx", "sketch", "none"):
        return cp
    if distinct == "auto":
        from tablesense.session import materialize
        cp = materialize(cp)
        wanted: dict[str, set[int]] = {}
        for r in cp.select("table_name", "ordinal", "row_count", "distinct_count").collect():  # a row per column
            if r.row_count and _needs_exact(r.row_count, r.distinct_count):
                wanted.setdefault(r.table_name, set()).add(r.ordinal)
        counts = exact_distinct(tables, wanted)
    else:
        counts = exact_distinct(tables)
    kept = [c for c in cp.columns]
    return (cp.join(F.broadcast(counts), ["table_name", "ordinal"], "left")  # a row per column
              .withColumn("distinct_count", F.coalesce("exact", "distinct_count", F.lit(0).cast("long"))).select(*kept))


def column_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name) from the schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, name) for t, df in tables.items() for i, (name, _, _, _) in enumerate(leaf_paths(df.schema), 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string")


def column_profile(df: DataFrame, table: str, distinct: str = "exact") -> DataFrame:
    """The column profile of one table (see ``catalog_column_profile``)."""
    return catalog_column_profile({table: df}, distinct)


# ---------------------------------------------------------------------------
# Derived column measures
# ---------------------------------------------------------------------------

def with_narrowed(cp: DataFrame) -> DataFrame:
    """Add ``base_dtype`` and ``narrowed`` (P15): the pandas dtype the
    reference would report, from the profile alone (SURVEY 8.1)."""
    z = F.col("null_count") > 0
    n = F.col("row_count")
    kind = F.col("kind")
    base = (F.when((kind == "int") & ~z, "int64")
            .when(kind.isin("int", "float"), "float64")
            .when((kind == "bool") & ~z, "bool")
            .when(kind == "timestamp", "datetime64[ns]")
            .otherwise("object"))
    lo, hi = F.col("min_num"), F.col("max_num")
    as_int = (F.when(lo > 0, F.when(hi < 255, "uint8").when(hi < 65535, "uint16")
                     .when(hi < 4294967295, "uint32").otherwise("int64"))
              .when((lo > -128) & (hi < 127), "int8")
              .when((lo > -32768) & (hi < 32767), "int16")
              .when((lo > -2147483648) & (hi < 2147483647), "int32")
              .otherwise("int64"))
    distinct_with_null = F.col("distinct_count") + F.when(z, 1).otherwise(0)
    narrowed = (F.when((F.col("base_dtype") == "int64") & (n > 0), as_int)
                .when((F.col("base_dtype") == "float64") & (F.col("f32_err") <= V.FLOAT32_TOLERANCE),
                      "float32")
                .when((F.col("base_dtype") == "object") & (n > 0)
                      & (distinct_with_null / n < CATEGORY_RATIO), "category")
                .otherwise(F.col("base_dtype")))
    return cp.withColumn("base_dtype", base).withColumn("narrowed", narrowed)


def distinct_ratio() -> Column:
    return F.when(F.col("row_count") > 0, F.col("distinct_count") / F.col("row_count"))


def date_form() -> Column:
    """Name of the form of a text column's dates; of two, if the values fit either reading."""
    names = [F.when(F.col("date_forms").bitwiseAND(bit) != 0, name) for name, bit in V.FORMS.items()]
    return F.when(F.col("date_forms").isNotNull(), F.concat_ws(" or ", *names))


def column_flags(cp: DataFrame, mode: str = "intended") -> DataFrame:
    """Per-column booleans that the table flags are ``bool_or`` of."""
    cp = with_narrowed(cp)
    kind, name = F.col("kind"), F.col("column_name")
    ratio = distinct_ratio()
    unique = (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)
    if mode == "observed":
        obj = F.col("narrowed") == "object"  # object and not category
        temporal = obj & (F.col("timestamp_ok") | (F.col("distinct_count") == 0))
        numeric = (F.col("narrowed").isin("int64", "int32", "int16", "float64", "float32")
                   | (obj & F.col("numeric_hit")))
        text = obj
        categorical = obj & (ratio < CATEGORY_RATIO)
        spatial_name = N.is_spatial_name(name, "observed")
        id_col = unique & (N.is_id_name(name) | F.col("narrowed").isin("int64", "int32"))
        range_candidate = kind.isin("int", "float") | F.col("timestamp_ok")
        nested = F.lit(False)
        # Q3: numbers convert as epoch nanoseconds (microsecond precision kept).
        as_ts = lambda c: F.timestamp_micros(F.floor(F.col(c) / 1000)).cast("timestamp_ntz")
        range_min = F.when(kind.isin("int", "float"), as_ts("min_num")).otherwise(F.col("ts_min"))
        range_max = F.when(kind.isin("int", "float"), as_ts("max_num")).otherwise(F.col("ts_max"))
    else:
        temporal = F.col("timestamp_ok") & kind.isin("string", "timestamp")
        numeric = kind.isin("int", "float") | ((kind == "string") & F.col("numeric_hit"))
        text = kind == "string"
        categorical = (kind == "string") & (ratio < CATEGORY_RATIO)
        spatial_name = N.is_spatial_name(name, "intended")
        id_col = unique & (N.is_id_name(name) | (kind == "int"))
        range_candidate = temporal
        nested = (kind == "nested") | F.col("from_struct")
        range_min, range_max = F.col("ts_min"), F.col("ts_max")
    return (cp.withColumn("is_temporal", F.coalesce(temporal, F.lit(False)))
              .withColumn("is_numeric", F.coalesce(numeric, F.lit(False)))
              .withColumn("is_text", F.coalesce(text, F.lit(False)))
              .withColumn("is_categorical", F.coalesce(categorical, F.lit(False)))
              .withColumn("is_spatial_name", spatial_name)
              .withColumn("is_unique_id", F.coalesce(id_col, F.lit(False)))
              .withColumn("is_range_candidate", F.coalesce(range_candidate, F.lit(False)))
              .withColumn("is_nested", nested)
              .withColumn("date_form", F.when(F.col("is_temporal"), date_form()))
              .withColumn("range_min", range_min)
              .withColumn("range_max", range_max)
              .withColumn("lower_name", F.lower(name)))


# ---------------------------------------------------------------------------
# Duplicate rows
# ---------------------------------------------------------------------------

def _comparable(df: DataFrame) -> list[str]:
    """SQL of every column in a form that hashes and groups (maps too)."""
    return [canonical("`" + f.name.replace("`", "``") + "`", f.dataType) for f in df.schema.fields]


def row_hash(df: DataFrame, seed: int | None = None) -> Column:
    """64-bit hash of a row; another one for every ``seed``."""
    first = [] if seed is None else [str(seed)]
    return F.expr(f"xxhash64({', '.join(first + _comparable(df))})")


def catalog_duplicate_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows equal to an earlier row, per table: (table_name, duplicate_rows).

    Step 1, one shuffle for the whole catalog: an 8-byte hash per row,
    counted map-side, keeps the hashes seen more than once, written to the
    checkpoint folder. Step 2 runs only for tables that have such hashes: their
    rows are grouped by all columns with partial aggregation, so many copies of
    a row are one record per task, after a semi-join to the repeated hashes
    (Spark broadcasts them if they are small; hash collisions do not count).
    """
    from tablesense.session import materialize
    spark = next(iter(tables.values())).sparkSession
    names = list(tables)
    hashes = reduce(DataFrame.union, [
        df.select(F.lit(i).alias("tno"), row_hash(df).alias("__h"))
        for i, df in enumerate(tables.values()) if df.columns])
    repeated = materialize(hashes.groupBy("tno", "__h").count().where(F.col("count") > 1)
                           .select("tno", "__h"))
    found = {r["tno"] for r in repeated.select("tno").distinct().collect()}
    parts = [spark.createDataFrame([(t, 0) for i, t in enumerate(names) if i not in found],
                                   "table_name string, duplicate_rows long")]
    for i in sorted(found):
        df = tables[names[i]]
        rows = df.select(*[F.expr(e).alias(f"c{n}") for n, e in enumerate(_comparable(df))], row_hash(df).alias("__h"))
        part = rows.join(repeated.where(F.col("tno") == i).select("__h"), "__h", "left_semi")
        groups = part.groupBy(*rows.columns).count()
        parts.append(groups.agg(
            F.lit(names[i]).alias("table_name"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))
    return reduce(DataFrame.unionByName, parts)


def duplicate_rows(df: DataFrame, table: str) -> DataFrame:
    return catalog_duplicate_rows({table: df})


# ---------------------------------------------------------------------------
# Table profile
# ---------------------------------------------------------------------------

def table_profile(cp: DataFrame, dups: DataFrame | None = None, mode: str = "intended",
                  formats: dict[str, str] | None = None) -> DataFrame:
    """One row per table from a column profile (and duplicate counts)."""
    cf = column_flags(cp, mode)
    weight = (F.when(F.col("kind") == "string", WEIGHT_TEXT)
              .when(F.col("kind").isin("int", "float"), WEIGHT_WIDE_NUMBER)
              .otherwise(WEIGHT_OTHER))
    if mode == "observed":
        weight = (F.when(F.col("narrowed") == "object", WEIGHT_TEXT)
                  .when(F.col("narrowed").isin("int64", "float64"), WEIGHT_WIDE_NUMBER)
                  .otherwise(WEIGHT_OTHER))
    lname = F.col("lower_name")
    first_range = F.min_by(F.struct(F.col("range_min").alias("ts_min"),
                                    F.col("range_max").alias("ts_max")),
                           F.when(F.col("is_range_candidate"), F.col("ordinal")))
    agg = cf.groupBy("table_name").agg(
        F.max("row_count").alias("record_count"),
        F.count(F.lit(1)).cast("int").alias("field_count"),
        F.bool_or("is_temporal").alias("has_temporal"),
        F.bool_or("is_numeric").alias("has_numeric"),
        F.bool_or("is_text").alias("has_text"),
        F.bool_or("is_categorical").alias("has_categorical"),
        (F.bool_or("is_spatial_name")
         | (F.bool_or(lname == "x") & F.bool_or(lname == "y"))).alias("has_spatial"),
        F.bool_or("is_nested").alias("has_nested"),
        F.array_sort(F.collect_list(F.when(F.col("is_unique_id"),
                                           F.struct("ordinal", "column_name")))).alias("_ids"),
        first_range.alias("_range"),
        (F.sum("byte_size") / F.lit(MB)).alias("estimated_size_mb"),
        F.sum("null_count").cast("long").alias("null_cells"),
        F.sum(F.col("byte_size") * weight).alias("_weighted"),
        F.sum("byte_size").alias("_bytes"),
    )
    out = (agg.withColumn("unique_ids", F.transform("_ids", lambda s: s["column_name"]))
              .withColumn("ts_min", F.col("_range.ts_min"))
              .withColumn("ts_max", F.col("_range.ts_max"))
              .withColumn("compression_ratio",
                          F.when(F.col("_bytes") > 0, F.col("_weighted") / F.col("_bytes"))
                          .otherwise(F.lit(1.0)))
              .drop("_ids", "_range", "_weighted", "_bytes"))
    if dups is not None:
        out = out.join(F.broadcast(dups), "table_name", "left")
    else:
        out = out.withColumn("duplicate_rows", F.lit(None).cast("long"))
    cells = F.col("record_count") * F.col("field_count")
    null_ratio = F.when(cells > 0, F.col("null_cells") / cells).otherwise(F.lit(0.0))
    dup_ratio = F.when(F.col("record_count") > 0,
                       F.coalesce(F.col("duplicate_rows"), F.lit(0)) / F.col("record_count")
                       ).otherwise(F.lit(0.0))
    out = out.withColumn("null_ratio", null_ratio).withColumn("dup_ratio", dup_ratio)
    out = out.withColumn("quality_score",
                         F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                                                        1.0 - (F.col("null_ratio") + F.col("dup_ratio")))))
    fmt = F.lit("parquet")
    if formats:
        fmt = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in formats.items() for x in kv]),
                                      F.col("table_name")), F.lit("parquet"))
    return out.withColumn("format", fmt).withColumn("mode", F.lit(mode))


def profile_catalog(tables: dict[str, DataFrame], mode: str = "intended",
                    distinct: str = "exact") -> tuple[DataFrame, DataFrame]:
    """(column_profile, table_profile) for a dict of named tables."""
    cp = catalog_column_profile(tables, distinct)
    tp = table_profile(cp, catalog_duplicate_rows(tables), mode)
    return cp, tp
