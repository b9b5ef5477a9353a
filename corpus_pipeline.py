"""From raw documents to packed training sequences: five stages, each written and read again.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns the next docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.llm import minhash_dedup, mixing, packing, quality_model, secret_scan
from leadsieve.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.scored(docs, model, keep=True).where(F.col("score") >= quality_model.THRESHOLD).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return minhash_dedup.without_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without an id are drawn as one, since only the id tells rows apart here.
    """
    drawn = mixing.mix_documents(docs).groupBy("doc_id").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    drawn = drawn.withColumnRenamed("doc_id", "_id")
    taken = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every copy with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packed),
]

#: A learned network, sampled signatures and tokenizers have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is kept in the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
