"""The corpus pipeline: documents in, packed training bins out; each stage works on all that the one before it kept.

Stages are (name, function of (spark, docs, sf_dir)). Each result is written as Parquet in the shared folder and read
again before the next stage, so a lost executor costs at most the stage at work. All stages but the last return the
columns of their input. Nulls, empty texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import base, decontamination, neardup, packing, quality_rules, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the induced lexicon stays below the threshold."""
    return toxicity.reject(docs, base.parquet(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject."""
    return quality_rules.keep(docs, base.parquet(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test string of the benchmark."""
    return decontamination.clean(docs, base.parquet(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models, sampling and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's side tables and its input, if it is a copy, are deleted when its result is written."""
    docs = base.parquet(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = base.mark()
        result = base.written(stage(spark, docs, sf_dir), f"stage{k}")
        base.discard(spark, since - (k > 0), keep=1)
        docs = result
    return docs
