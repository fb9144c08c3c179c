"""Registered queries of the operators of this subpackage: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.near_dedup import near_classes

    return near_classes(_table(spark, sf_dir, "documents"))


def op4_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.vp_tree import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.language_id import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.hilbert import hilbert_shards

    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from verdigris.llm.bpe import bpe_tokens

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_tokens(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_pii,
        op3_near_dedup,
        op4_vantage_point_trees,
        op5_language_id,
        op6_exact_dedup,
        op7_hilbert_sharding,
        op8_warc,
        op9_byte_level_bpe,
        op10_source_mixing,
        op11_spelling_variants,
        op12_filter_audit,
        op13_simhash,
    )
}
