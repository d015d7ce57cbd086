"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe_codec, cap_filters, decontaminate, lines, prefix_trie, repeats, rules, sharding, simhash, token_counts, token_files, toxicity
from .common import text_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_batches(_table(spark, sf_dir, "documents"))


def op1_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), 8)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), width=3, words=1, segments=4, most=3)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_documents(spark, sf_dir), lines.MIN_SITES)


def op8_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_documents(spark, sf_dir), repeats.LENGTH)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(_table(spark, sf_dir, "embeddings"), cap_filters.LIMIT)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_kk_shards, op2_bpe_codec, op3_quality_rules, op4_toxicity, op5_simhash, op6_token_files, op7_line_dedup, op8_bwt_repeats, op9_decontaminate, op10_token_counts,
        op11_cap_filters, op12_alignment, op13_prefix_trie,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Where SQL states an operator's whole result. The others are tested in tests/llm."""
    return {"op7_line_dedup": lines.SQL.format(n=lines.MIN_SITES), "op13_prefix_trie": prefix_trie.SQL.format(every=100, turns=6)}
