"""Registered queries of this subpackage: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    benchmark_align,
    bestfit_pack,
    block_lstm,
    compress_lang,
    license_rules,
    paragraph_minhash,
    piecewise_hash,
    preference_format,
    simhash_bytes,
    warc_merkle,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bytes.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_piecewise_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.compare_with_edited(table(spark, sf_dir, "documents"))


@query("op3_compression_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_lang.identify(table(spark, sf_dir, "documents"))


@query("op4_paragraph_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_minhash.duplicate_paragraphs(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_align.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_block_lstm_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_lstm.main_text(table(spark, sf_dir, "pages"))


@query("op1_preference_format", preference_format.QUERY_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.swapped_preferences(table(spark, sf_dir, "conversations"))


@query("op2_license_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.find_licences(table(spark, sf_dir, "documents"))


@query("op10_warc_merkle_audit", warc_merkle.query_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc_merkle.audit(*[warc_merkle.digests(x, warc_merkle.record(), "page_id") for x in (pages, warc_merkle.damaged_copy(pages))])
