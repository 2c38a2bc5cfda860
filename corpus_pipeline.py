"""A training-corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.llm import exact_dedup, packing, simhash, substring_dedup, toxicity
from provloom.llm.common import discard, keep, scratch, stored, table
from provloom.llm.queries import split_pattern, vocabulary

#: Words of a repeated passage that goes.
PASSAGE = 25


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model learns from the labelled ones among docs."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, one row stays, with the largest doc_id."""
    return exact_dedup.without_copies(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts one row stays, with the smallest doc_id."""
    return simhash.without_similar(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words or more go from all documents but the first that has them; n_chars follows the text."""
    removed = substring_dedup.free_name(docs, "n_removed")
    out = substring_dedup.remove_repeats(docs, PASSAGE, texts=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_copies_out), ("near_dedup", near_copies_out), ("substring_dedup", repeats_out), ("packing", packed)]

#: Learned scores, fingerprints and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's tables are freed as soon as its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        was = docs
        with scratch(spark):
            docs = keep(stored(stage(spark, was, sf_dir)))
        if hasattr(was, "stored_at"):
            discard(was)
    return STAGES[-1][1](spark, docs, sf_dir)
