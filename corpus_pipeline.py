"""A corpus from raw documents to packed batches: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.decontam import drop_leaks
from lithos.llm.jaccard import near_duplicates
from lithos.llm.linededup import line_dedup
from lithos.llm.packing import pack
from lithos.llm.store import shared_folder
from lithos.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, trained on all labels of docs, rejects. Null, empty and
    wordless texts stay; without labels nothing goes."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that stand elsewhere already; a document that had words and has none left is
    a copy and goes. Null, empty and blank texts stay."""
    out = line_dedup(docs, removed="__removed")
    out = out.where((F.size("__removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    fresh = F.when(F.size("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", fresh).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. The smallest doc_id stays;
    null, empty and blank texts, and a null doc_id, are in no group and stay."""
    return near_duplicates(docs, k=5, t=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark; null, empty and wordless texts hold none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all that is left; null, empty and blank texts are in no batch."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: The stages learn, hash and search; SQL can't express them. tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; what each returns is written as Parquet and read again."""
    at = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}_{name}")
        docs = spark.read.parquet(f"{at}/{i}_{name}")
    return docs
