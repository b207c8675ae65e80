"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Every stage works on all its predecessor kept. The first four return the columns
of documents; the last returns the pieces of the packed sequences. Rows without
text pass the filters like empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, linededup, nearsets, packing, quality
from tidelog.llm.common import stash, table
from tidelog.llm.registry import query


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality posterior accepts; the site is the source, the path its language section."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by three or more documents stay in the last of them only; n_chars follows the text."""
    kept = linededup.drop_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(
            docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8 or more): the one with the least id.

    SimHash proposes pairs, a prefix join those beyond its radius; whole sets settle them.
    """
    return nearsets.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("line_dedup", fresh_lines), ("near_dedup", one_of_each),
          ("decontamination", without_benchmarks), ("packing", packed)]

#: Classifier, SimHash and tokenizer have no SQL form; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs


query("pipeline")(run)
