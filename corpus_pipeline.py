"""A training corpus from raw documents: STAGES, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of documents. ORACLE_SQL is None: SQL can't express the
trained classifier, so the stages are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import cotraining, jaccard, lines, mixing, packing
from loomset.llm.common import Scratch, drop_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return cotraining.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each group of lines, n_chars being that of the text that is left."""
    kept = lines.deduped(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight; documents come as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch() as outputs:  # a stage's output goes when the next one is written
        for i, (_, stage) in enumerate(STAGES[:-1]):
            with Scratch() as made:
                docs = made.keep(stage(spark, docs, sf_dir), f"stage-{i}")
            while len(outputs.paths) > 1:
                drop_path(*outputs.paths.pop(0))
        outputs.paths.clear()
    return STAGES[-1][1](spark, docs, sf_dir)
