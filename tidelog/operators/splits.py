"""Chronological splits and rolling origins over the day dimension (one row per calendar day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import literal_rows

# Nominal proportions of the three periods.
TRAIN_FRAC = 60 / 116
DEV_FRAC = 21 / 116


def day_axis(log: DataFrame) -> DataFrame:
    """(day, n, clicks) from the log, or from daily cell counts when those exist already."""
    if "n" in log.columns:
        return log.groupBy("day").agg(F.sum("n").alias("n"), F.sum("clicks").alias("clicks"))
    return log.groupBy("day").agg(F.count("*").alias("n"), F.sum("click").alias("clicks"))


def dev_test(days: DataFrame, warmup: int, test_frac: float) -> DataFrame:
    """Role of every eligible day; the last round(n * frac) (half to even, at least one) are the test."""
    top = days.agg(F.max("day").alias("_top"))
    span = top.select(F.explode(F.sequence(F.lit(warmup + 1), F.col("_top"))).alias("day"), "_top")
    n = F.col("_top") - warmup
    n_test = F.greatest(F.lit(1), F.bround(n * F.lit(test_frac)).cast("int"))
    return span.select("day", F.when(F.col("day") > F.col("_top") - n_test, "test").otherwise("dev").alias("role"))


def three_way(days: DataFrame, warmup: int, train_frac: float = TRAIN_FRAC, dev_frac: float = DEV_FRAC) -> DataFrame:
    """Train / dev / test role of days 0..max in fixed proportions, warm-up enforced."""
    top = days.agg((F.max("day") + 1).alias("_n"))
    n = F.col("_n")
    n_dev = F.greatest(F.lit(1), F.bround(n * F.lit(dev_frac)).cast("int"))
    n_train = F.least(F.greatest(F.lit(warmup), F.bround(n * F.lit(train_frac)).cast("int")), n - n_dev - 1)
    span = top.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("day"),
                      n_train.alias("_a"), (n_train + n_dev).alias("_b"))
    role = F.when(F.col("day") < F.col("_a"), "train").when(F.col("day") < F.col("_b"), "dev").otherwise("test")
    return span.select("day", role.alias("role"))


def inner_days(days: DataFrame, origins: DataFrame, k: int, warmup: int) -> DataFrame:
    """For each origin, the last k earlier days past warm-up that have history themselves."""
    first = days.agg(F.min("day").alias("_first"))
    usable = days.select("day").crossJoin(first).filter(
        (F.col("day") >= warmup) & (F.col("day") > F.col("_first"))).select(F.col("day").alias("inner_day"))
    pairs = origins.select(F.col("day").alias("origin")).join(usable, F.col("inner_day") < F.col("origin"))
    latest = Window.partitionBy("origin").orderBy(F.col("inner_day").desc())
    return pairs.withColumn("recency", F.row_number().over(latest)).filter(F.col("recency") <= k)


def holdout(days: DataFrame, frac: float | None = None) -> DataFrame:
    """First ``frac`` of the days to fit, rest to hold out; without ``frac`` only the last day is held out."""
    w = Window.orderBy("day")  # one row per calendar day
    ranked = days.select("day", F.row_number().over(w).alias("_r"))
    ranked = ranked.crossJoin(days.agg(F.count("*").alias("_n")))
    cut = F.col("_n") - 1 if frac is None else F.greatest(F.lit(1), F.floor(F.col("_n") * frac))
    return ranked.select("day", F.when(F.col("_r") <= cut, "fit").otherwise("hold").alias("part"))


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Cartesian product of small parameter axes, one numbered configuration per row."""
    out = None
    for name, values in axes.items():
        kind = "string" if isinstance(values[0], str) else "double"
        axis = literal_rows(spark, [(v if kind == "string" else float(v), i) for i, v in enumerate(values)],
                            f"{name} {kind}, _i_{name} int")
        out = axis if out is None else out.crossJoin(axis)
    number = F.lit(0)
    for name, values in axes.items():
        number = number * len(values) + F.col(f"_i_{name}")
    return out.select(number.cast("int").alias("cfg"), *axes)
