"""The corpus pipeline: five stages over documents, each written as Parquet and
read again as the next one's input.

Every stage works on all rows its predecessor kept. All but the last return the
columns of documents; the last returns one row per text of the mix, with its
token ids. ``ORACLE_SQL`` is None: naive Bayes, the Jaccard join, the cube
method and BPE have no SQL form; tests/llm holds each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm import bpe, cube, exactdedup, langid, setjoin
from tablesense.llm.common import maybe_broadcast, read, written

LEAST_SCORE = 0.5  # of the language


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt from all rows that have a language. Rejects texts
    without a letter and those whose language is less likely than
    ``LEAST_SCORE``; a missing language is filled in."""
    docs = docs.drop("lang_pred", "score")  # would clash with the operator's results
    out = langid.identify(docs, langid.train(docs))
    kept = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest doc_id stays."""
    return exactdedup.exact_dedup(docs).where("kept").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 80 % or more of their five-word shingles the one with
    the smallest doc_id stays. Rows are told apart by doc_id; where several
    rows have one, or none has, by a negative number made from doc_id and text,
    so each of them is judged on its own text (and stands before the others)."""
    several = written(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__several"), F.lit(True).alias("__many")), "repeated-ids")
    own = F.bitwise_not(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))  # below zero
    row = F.when(F.col("__many"), own).otherwise(F.col("doc_id").cast("long"))
    told = docs.join(maybe_broadcast(several), docs.doc_id.eqNullSafe(F.col("__several")), "left").withColumn("__row", row)
    classes = setjoin.jaccard_join(told.select("__row", "text"), k=5, p=80, q=100, id_col="__row")
    gone = written(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    return told.join(maybe_broadcast(gone), F.col("__row") == F.col("gone"), "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source mix takes it."""
    out = cube.mix_sources(docs).where("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    path, pattern = bpe.public_vocabulary()
    return bpe.bpe(docs, path, pattern, keep_decoded=False, keep=["doc_id", "lang", "source"], release=True)


STAGES = [("language ID", language_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("source mixing", mix_stage), ("byte-level BPE", encode_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
