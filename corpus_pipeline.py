"""A corpus pipeline of four stages over ``documents``: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import near_dup, packing, quality, toxicity
from loomgraph.llm.common import Scratch


#: Ids that may be broadcast (8 bytes each); beyond, documents are shuffled to them.
BROADCAST_IDS = 2_000_000


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Documents whose id has no verdict against it. Rows without id stay; rows that repeat an id are one document."""
    gone = verdicts.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles stays: the one with the least id."""
    verdicts = Scratch(spark, "pipeline").save(near_dup.classes(docs, k=5, percent=80), "classes")
    return _kept(docs, verdicts)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_documents), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL can express neither the learnt verdicts nor the packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, with a written table between any two."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = scratch.save(made, f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
