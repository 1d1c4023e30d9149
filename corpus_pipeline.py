"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

quality classifier -> quality rules -> exact dedup -> near dedup -> packing. All but the last return the columns of
documents. A stage sees what the one before it kept and nothing else of the documents; the classifier also reads the
labels. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules
from tokenloom.llm.common import forget, scratch, small_batches, table
from tokenloom.llm.queries import tokenizer

#: SQL can't express the first stage, a trained network.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from those not held out, doesn't reject."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(quality_model.may_learn())
    return quality_model.accepted(docs, quality_model.learn(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_rules.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest identifier."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates at a similarity of 0.8, the one with the smallest identifier."""
    small_batches(spark)
    return near_dedup.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of 2048 tokens."""
    # Smaller batches and fewer remembered words than alone: the workers live on beside those of the other stages.
    small_batches(spark, size="3m")
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), kept=100_000, with_ids=True)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if name != STAGES[0][0]:
            forget(docs)  # what the stage before kept; a lost executor's tasks read files of this stage from here on
        docs = spark.read.parquet(path)
    return docs
