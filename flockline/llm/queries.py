"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from ._session import cut, shared_folder
from .ann import nearest
from .decontam import decontaminate
from .jaccard_join import jaccard_join
from .mixing import mix
from .phrase_dedup import phrase_dedup
from .pii import pseudonymise
from .secret_scan import scan
from .suffix_dedup import suffix_dedup
from .token_rollup import VOCABULARIES, WORDS, RollupStore, deletes, inserts, revisions, token_counts
from .toxicity import toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors to every vector whose id 100 divides."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer after inserts, a replay, deletes and revised counts.

    All documents are inserted for two tokenizer versions; the first batch is sent once more, which
    must change nothing; the documents of ids that 10 divides are deleted and inserted again, and
    their counts by words revised and put back, so that the totals are those of the whole table.
    """
    docs = _docs(spark, sf_dir)
    store = RollupStore(spark, f"{shared_folder(spark)}/rollup-{uuid4().hex}")
    bpe = cut(token_counts(docs, "byte_bpe_50k", f"{VOCABULARIES}/byte_bpe_50k.tiktoken"))
    words = cut(token_counts(docs, WORDS))
    store.commit("insert-bpe", inserts(bpe))
    store.commit("insert-words", inserts(words))
    store.commit("insert-bpe", inserts(bpe))
    some = F.col("doc_id") % 10 == 0
    wrong = words.where(some).withColumn("n_tokens", F.col("n_tokens") + 1)
    store.commit("delete", deletes(bpe.where(some)))
    store.commit("revise", revisions(words.where(some), wrong))
    store.compact()
    store.commit("insert-again", inserts(bpe.where(some)))
    store.commit("revise-back", revisions(wrong, words.where(some)))
    return store.totals()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join(_docs(spark, sf_dir), 3, 90).drop("th")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under a 50-byte repeat of an earlier document, removed from every document."""
    return suffix_dedup(_docs(spark, sf_dir)).drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 in turn and repeat 3 times at most."""
    return mix(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their validated numbers, dates and addresses under pseudonyms."""
    return pseudonymise(_docs(spark, sf_dir).select("doc_id", "text"))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under a 50-word repeat of an earlier document, removed from every document."""
    return phrase_dedup(_docs(spark, sf_dir)).drop("spans")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents, with the forest's score."""
    return scan(_docs(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
