"""Queries over the whole tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoalgraph.llm import oracle
from shoalgraph.llm.bagminhash import near_duplicates
from shoalgraph.llm.html_extract import extract_main_text
from shoalgraph.llm.line_dedup import dedup_lines
from shoalgraph.llm.license_scan import license_report
from shoalgraph.llm.lsa_decontam import contamination
from shoalgraph.llm.packing import pack
from shoalgraph.llm.quality_rules import quality_report
from shoalgraph.llm.repeated_spans import remove_repeats
from shoalgraph.llm.runtime import read
from shoalgraph.llm.sharding import shard_by_bytes
from shoalgraph.llm.token_counts import token_counts


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"), report=True)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"), min_pages=10)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), least=0.8)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents"), n_shards=24)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", length=2048, end=1)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), model="piece_bpe_32k.model", limit=4096)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), length=50)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents")).drop("p_good")


ALL = [op1_line_dedup, op2_html_extraction, op3_minhash, op4_sharding, op5_packing, op6_license_scan, op7_token_counts, op8_decontamination, op9_suffix_dedup, op10_quality_rules]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tests hold the others against brute force."""
    return oracle.oracle_sql()
