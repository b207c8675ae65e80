"""Causality and identity checks as queries: each returns how much was compared and how much differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flip(log: DataFrame, where: Column, label: str = "click") -> DataFrame:
    """The log with the labels of the chosen rows inverted."""
    return log.withColumn(label, F.when(where, 1 - F.col(label)).otherwise(F.col(label)))


def differing(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tol: float = 1e-12) -> DataFrame:
    """Full outer comparison on the keys: (keys..., changed). A key missing on one side counts as changed."""
    left = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        same = same & (x.eqNullSafe(y) | (F.abs(x - y) <= tol))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return left.join(right, keys, "full_outer").select(
        *keys, (~(both & F.coalesce(same, F.lit(False)))).alias("changed"))


def tally(name: str, compared: DataFrame) -> DataFrame:
    """(check, compared, differing) of a table with a ``changed`` flag."""
    return compared.agg(F.count("*").alias("compared"), F.count_if("changed").alias("differing")).select(
        F.lit(name).alias("check"), "compared", "differing")


def permutation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, duplicates counted."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
