"""A training-text pipeline: quality rules, exact, near and substring deduplication, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and reread for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenwell.llm import exact, jaccard, packing, rules, spans
from screenwell.llm.shared import kept
from screenwell.llm.tokenizers import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and a decision list learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.keep_good(docs, rules.learn_rules(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_component(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup),
          ("substring dedup", substring_dedup), ("packing", packed)]
# The learned rules and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
