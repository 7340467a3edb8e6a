"""The corpus pipeline: documents in, cleaned and mixed documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  A stage works on all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from flockline.llm import stages
from flockline.llm._session import shared_folder

STAGES = [
    ("toxicity", stages.toxicity),
    ("near duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("mixing", stages.mixing),
]

#: Toxicity scores, shingle classes and pseudonyms are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
