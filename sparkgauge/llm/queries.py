"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import host_rules, importance, line_quality, line_runs, media, merkle, ngram_join, packing, pii, sentencepiece_codec, suffix_dedup, token_shards, toxicity
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_quality(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(documents(spark, sf_dir))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_output(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_line_breaks(documents(spark, sf_dir))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array, op2_host_rules, op3_sentencepiece, op4_media_chunks, op5_pii_crf, op6_length_buckets, op7_ngram_jaccard, op8_toxicity, op9_line_quality, op10_token_shards, op11_merkle, op12_importance, op13_line_runs)
}

ORACLES: dict[str, str] = {"op2_host_rules": host_rules.SQL, "op11_merkle": merkle.SQL, "op12_importance": importance.SQL, "op13_line_runs": line_runs.SQL}
