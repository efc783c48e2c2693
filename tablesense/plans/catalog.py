"""The driver's test catalog: table names and loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_all(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {t: load(spark, sf_dir, t) for t in (names or TABLES)}


# Schemas of the driver's tables (name, spark kind, byte width or None).
# Used to write the DuckDB oracle SQL, which has no schema walk of its own.
SCHEMAS: dict[str, list[tuple[str, str, int | None]]] = {
    "region": [("r_regionkey", "int", 4), ("r_name", "string", None)],
    "nation": [("n_nationkey", "int", 4), ("n_name", "string", None), ("n_regionkey", "int", 4)],
    "customer": [("c_custkey", "int", 8), ("c_name", "string", None), ("c_nationkey", "int", 4),
                 ("c_acctbal", "float", 8), ("c_mktsegment", "string", None)],
    "supplier": [("s_suppkey", "int", 8), ("s_name", "string", None), ("s_nationkey", "int", 4),
                 ("s_acctbal", "float", 8)],
    "part": [("p_partkey", "int", 8), ("p_name", "string", None), ("p_brand", "string", None),
             ("p_type", "string", None), ("p_size", "int", 4), ("p_retailprice", "float", 8)],
    "orders": [("o_orderkey", "int", 8), ("o_custkey", "int", 8), ("o_orderstatus", "string", None),
               ("o_totalprice", "float", 8), ("o_orderdate", "timestamp", 8),
               ("o_orderpriority", "string", None)],
    "lineitem": [("l_orderkey", "int", 8), ("l_partkey", "int", 8), ("l_suppkey", "int", 8),
                 ("l_linenumber", "int", 4), ("l_quantity", "float", 8),
                 ("l_extendedprice", "float", 8), ("l_discount", "float", 8), ("l_tax", "float", 8),
                 ("l_returnflag", "string", None), ("l_linestatus", "string", None),
                 ("l_shipdate", "timestamp", 8)],
    "events": [("event_id", "int", 8), ("ts", "timestamp", 8), ("user_id", "int", 8),
               ("event_type", "string", None), ("value", "float", 8), ("props", "string", None)],
    "documents": [("doc_id", "int", 8), ("text", "string", None), ("lang", "string", None),
                  ("source", "string", None), ("n_chars", "int", 8)],
    "embeddings": [("vec_id", "int", 8), ("embedding", "nested", 4), ("label", "int", 4)],
    "pages": [("page_id", "int", 8), ("url", "string", None), ("html", "string", None)],
    "benchmark": [("item_id", "int", 8), ("text", "string", None)],
    "labels": [("doc_id", "int", 8), ("quality", "int", 4), ("toxic", "int", 4)],
    "conversations": [("conv_id", "int", 8), ("turn", "int", 8), ("role", "string", None),
                      ("text", "string", None)],
}
