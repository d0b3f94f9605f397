"""A corpus pipeline: each stage takes the documents that its predecessor kept, written and read again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, mixing, ngram_join, sentencepieces, toxicity

MODEL = os.environ.get("PIPELINE_TOKENIZER", sentencepieces.MODEL)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples mark as toxic go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 the one with the smallest doc_id stays."""
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards tempered source, language and topic shares."""
    return mixing.sample_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every document that is left."""
    whole = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    return sentencepieces.encode(whole, MODEL).select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity, the near copies' components and the pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, common.keep(out)
        common.free(before)
