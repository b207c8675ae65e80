"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import (bursttrie, codesearch, decontaminate, egojoin, importance, langid, licenses, linededup, packing, pii, quality,
                         repeats, simhash)
from tidelog.llm.common import table
from tidelog.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3(table(spark, sf_dir, "documents"))


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(table(spark, sf_dir, "documents"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op7(table(spark, sf_dir, "documents"))


@query("op8_code_search", codesearch.SQL)
def op8_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codesearch.op8(table(spark, sf_dir, "embeddings"))


@query("op9_licenses")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op9(table(spark, sf_dir, "documents"))


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op10(table(spark, sf_dir, "documents"))


@query("op11_importance", importance.SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_conversation_trie", bursttrie.SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursttrie.op12(table(spark, sf_dir, "conversations"))


@query("op13_embedding_near_dedup", egojoin.SQL)
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.op13(table(spark, sf_dir, "embeddings"))
