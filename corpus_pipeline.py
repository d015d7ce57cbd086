"""A corpus pipeline over ``documents``: each stage calls one corpus operator on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next one's documents. All but the last return the columns of ``documents``.
Null and empty texts pass through every stage (as near-duplicates of each other, one of them stays). Columns beyond those of
``documents`` stay as they are, whatever their names; empty tables give empty results. Repeated rows are judged alike: what
goes, goes with all its copies, and of near-duplicates the least id stays, once. ``run`` deletes a stage's
tables in the shared folder as soon as its result is written, and that result as soon as its successor's is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import bpe_codec, decontaminate, lines, simhash, toxicity
from broadsheet.llm.common import dropped, passing, saved


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but in one document."""
    return lines.without_boilerplate(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles) the document of the least id stays."""
    return simhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is encoded and decoded again."""
    return bpe_codec.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_stage), ("line_dedup", line_stage), ("simhash", near_duplicate_stage), ("decontaminate", benchmark_stage), ("bpe", bpe_stage)]

#: SQL can state neither the scores nor the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(f"after_{name}"):
            new = saved(stage(spark, docs, sf_dir), f"after_{name}")
        dropped(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
