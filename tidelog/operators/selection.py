"""Choosing configurations on matured inner losses, with explicit tie rules and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inner_losses(pairs: DataFrame, daily: DataFrame, cfg: list[str]) -> DataFrame:
    """Pooled loss of every configuration on the inner days of every origin.

    ``pairs``: (origin, inner_day). ``daily``: (cfg..., day, early, n, s), where
    ``early`` marks labels that arrive by the next midnight; the tail of the
    latest inner day is left out.
    """
    lag = F.when(F.col("early"), 1).otherwise(2)
    used = pairs.join(daily, (F.col("inner_day") == F.col("day")) & (F.col("day") + lag <= F.col("origin")))
    return used.groupBy("origin", *cfg).agg((F.sum("s") / F.sum("n")).alias("loss"))


def lowest(df: DataFrame, keys: list[str], loss: str, then: list[str], digits: int = 10) -> DataFrame:
    """Row with the lowest loss per key; ties go to the first in ``then``."""
    order = Window.partitionBy(*keys).orderBy(F.round(loss, digits), *then)
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def select_across_seeds(per_seed: DataFrame, cfg: list[str], complexity: str, tie: float = 1e-6) -> DataFrame:
    """Mean loss and mean worst day over seeds; among near-ties the mildest worst day, then the simplest.

    ``per_seed``: (seed, cfg..., complexity, loss, worst).
    """
    mean = per_seed.groupBy(*cfg, complexity).agg(F.round(F.avg("loss"), 10).alias("mean_loss"),
                                                  F.round(F.avg("worst"), 10).alias("mean_worst"))
    best = mean.agg(F.min("mean_loss").alias("_best"))
    near = mean.crossJoin(F.broadcast(best)).withColumn("_near", F.col("mean_loss") - F.col("_best") < tie)
    order = Window.partitionBy().orderBy(F.col("_near").desc(), "mean_worst", complexity)  # one row per configuration
    return near.withColumn("selected", (F.row_number().over(order) == 1)).drop("_best", "_near")


def one_se(folds: DataFrame, keys: list[str], cfg: str, complexity: str) -> DataFrame:
    """Simplest configuration within one standard error of the best mean fold loss.

    ``folds``: (keys..., cfg, complexity, loss), one row per fold.
    """
    score = folds.groupBy(*keys, cfg, complexity).agg(
        F.round(F.avg("loss"), 10).alias("score"),
        F.coalesce(F.round(F.stddev_samp("loss") / F.sqrt(F.count("loss")), 10), F.lit(0.0)).alias("se"))
    best = lowest(score, keys, "score", [complexity]).select(*keys, (F.col("score") + F.col("se")).alias("_limit"))
    inside = score.join(best, keys).filter(F.col("score") <= F.col("_limit"))
    order = Window.partitionBy(*keys).orderBy(complexity)
    return inside.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, cfg, "score", "_limit")


def gates(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One boolean per rule and their conjunction."""
    out = table.withColumns(rules)
    every = None
    for name in rules:
        every = F.col(name) if every is None else every & F.col(name)
    return out.withColumn("eligible", every)
