"""Registered queries over whole tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.audit import filter_audit
from feedloom.llm.chat import conversation_digests
from feedloom.llm.mixing import mix_sources
from feedloom.llm.perplexity import perplexity_filter
from feedloom.llm.pieces import encode_documents
from feedloom.llm.periods import periodic_runs
from feedloom.llm.pii import personal_data
from feedloom.llm.quality import quality_rules
from feedloom.llm.secrets import secret_spans
from feedloom.llm.simhash import near_duplicates
from feedloom.llm.substrings import without_repeats
from feedloom.llm.toxicity import toxicity
from feedloom.llm.vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(_table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_toxicity,
        op3_mix_sources,
        op4_substrings,
        op5_quality_rules,
        op6_secrets,
        op7_personal_data,
        op8_sentencepiece,
        op9_vectors,
        op10_perplexity,
        op11_filter_audit,
        op12_chat_format,
        op13_periodic_runs,
    )
}
