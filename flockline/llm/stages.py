"""The stages of corpus_pipeline.py.

Defined cases, for all: nulls in any column, empty and very long texts and repeated rows are taken as
the operator of the stage says; an empty table gives an empty one; extra columns stay, whatever their
names, but for the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import cut, fresh, same_columns
from . import decontam, jaccard_join, mixing as mixing_, pii as pii_, toxicity as toxicity_

SHINGLE, PERCENT = 5, 80
#: Rows of two numbers that are broadcast at most; more of them are joined by an exchange.
BROADCAST_ROWS = 500_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; null and empty texts get the bias alone, and stay where it does."""
    return toxicity_.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that five-word shingles with a similarity of 0.8 or more connect, one of the least id stays.

    Rows are told apart by id and text: of rows that share an id, those that link with no smaller
    one stay.  Equal rows count as one.  Rows without words or without an id stay.
    """
    found = jaccard_join.jaccard_join(docs, SHINGLE, PERCENT).where("component_id is not null and n_shingles > 0")
    found = cut(found.select("doc_id", "th", "component_id"))
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    mine = found.where("component_id = doc_id").groupBy("doc_id", "th").agg(F.count("*").alias("times"))  # few rows a class: those of its least id
    mine = mine.join(first, F.col("doc_id") == F.col("component_id")).withColumn("stays", F.col("th") == F.col("first.th"))
    gone = found.where("component_id <> doc_id").select("doc_id", "th").distinct().withColumn("again", F.lit(False))
    id_, th, again = fresh(docs, "doc"), fresh(docs, "th"), fresh(docs, "again")
    # what goes, and what is there several times and must stay once
    marked = gone.unionByName(mine.where("not stays or times > 1").select("doc_id", "th", F.col("stays").alias("again")))
    marked = cut(marked.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("again").alias(again)))
    size, several = marked.agg(F.count("*"), F.max(again)).first()
    side = F.broadcast(marked) if size <= BROADCAST_ROWS else marked
    here = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    kept = same_columns(docs.join(side, here, "left_anti"), docs)
    if several:
        once = docs.join(side.where(F.col(again)), here).dropDuplicates([id_, th])
        kept = kept.unionByName(same_columns(once, docs))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and wordless texts hold none."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars, where it is there, follows the text."""
    counts = fresh(docs, "found"), fresh(docs, "replaced")
    out = pii_.replaced(docs, pii_.KEY, counts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return same_columns(out, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: how often each document is repeated."""
    return mixing_.mix(docs)
