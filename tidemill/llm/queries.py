"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import round_trip
from .decontaminate import contamination_report
from .line_dedup import LINE_SQL, line_report
from .ngram_join import similar_documents
from .order_minhash import neighbour_report
from .passages import passage_report
from .quality import quality_report
from .sharding import shard_report
from .token_counts import count_report
from .token_store import read_tokens, write_tokens

JSON_50K = "byte_bpe_50k.json"
RANKS_50K = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_50K), end_id=2))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_report(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_50K))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_50K), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_line_dedup,
        op3_substring_dedup,
        op4_decontamination,
        op5_order_minhash,
        op6_token_counts,
        op7_byte_bpe,
        op8_quality,
        op9_sharding,
        op10_ngram_join,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINE_SQL}
