"""Queries of the training-data operators: ``opN_<name>(spark, sf_dir)`` over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, curriculum, gam, licenses, mincut, minhash, packing, pii, risk, toolcalls
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_bitsliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitslice.top_k(vectors, bitslice.stated_queries(vectors))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_chats(table(spark, sf_dir, "conversations"))


def op5_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.classify(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mincut.extract_pages(pages, mincut.train(pages))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.demo_key())


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_bitsliced_top_k, op3_harmonic_packing, op4_tool_call_linking, op5_gam_quality, op6_minhash_near_dedup,
        op7_mincut_extraction, op8_curriculum_mix, op9_pii_surrogates, op10_risk_rules,
    )
}
ORACLE_SQL = {
    "op2_bitsliced_top_k": bitslice.ORACLE_SQL,
    "op3_harmonic_packing": packing.ORACLE_SQL,
    "op8_curriculum_mix": curriculum.ORACLE_SQL,
    "op10_risk_rules": risk.ORACLE_SQL,
}
