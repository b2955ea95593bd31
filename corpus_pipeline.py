"""From documents to shards: rules, near-duplicates, benchmark leaks, the mix, the shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs; all but the last return the columns of ``docs``.

Edge cases, alike in every stage: an empty table gives an empty one; rows with null ids are treated like others;
columns that a stage does not name pass through, whatever they are called (the last stage replaces columns
named ``shard`` and ``slot``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import host_quality, sampled_splitters, setsketch, simhash_leaks, temperature_mix
from graphloom.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; in every host, also those that break a soft rule by far.

    Null and empty texts have no words and go; rows with a null source are one host; repeated rows are judged alike.
    """
    return host_quality.keep_documents(docs, params=host_quality.QualityParams(doc_slack=0.5))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words a shingle, similarity 0.8 or more) one row stays: that of the smallest id.

    Of rows repeated in id and text one stays; rows that share an id but not a text are told apart; texts without
    words are in no class and stay.
    """
    return setsketch.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, and without items all documents stay."""
    return simhash_leaks.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated (up to twice) towards the target weights; none is left out.

    Rows with a null source are one source; documents of a source without tokens pass once.
    """
    return temperature_mix.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot; equal texts lie side by side, repeated rows get slots of their own."""
    return sampled_splitters.assign_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The near-duplicate and leak stages hash words in ways that SQL has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
