"""A training-text pipeline of the text operators: each stage reads the documents that the stage before it kept.

STAGES: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but for the
last. run() applies them to the documents, each stage written to the shared folder and read again. The stages learn, hash and
pack, which SQL cannot express, so ORACLE_SQL is None; tests hold them against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm import quality_fm, secret_scan
from spliceflow.llm.common import documents, drop_stored, fold, stored
from spliceflow.llm.minhash import near_duplicates
from spliceflow.llm.packing import pack_documents
from spliceflow.llm.sentence_spans import remove_repeats

#: Documents that score lower are rejected.
LEAST_QUALITY = 0.3
SEQUENCE = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It is fitted on labelled documents of the given table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0)
    model = quality_fm.train(docs, labels, metadata=["n_chars"])
    return quality_fm.score(docs, model, metadata=["n_chars"]).where(F.col("score") >= LEAST_QUALITY).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates (five words, similarity 0.8). Rows that repeat
    both id and text are one; rows without an id stay."""
    groups = near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    kept = groups.where("kept and doc_id is not null").select("doc_id").distinct()
    out = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("h")).count().where("count > 1")
    if repeated.limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.union(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a marker."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), length=SEQUENCE)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
