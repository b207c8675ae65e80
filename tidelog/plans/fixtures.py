"""Inputs the registered queries share, each derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import hashing as hs
from tidelog.functions import scoring as sc
from tidelog.operators import history as hi
from tidelog.plans.registry import SHARED
from tidelog.session import attach, settle
from tidelog.sources import logs

WARMUP_DAYS = 3
TEST_FRAC = 0.3
FIRST_ELIGIBLE = WARMUP_DAYS + 1
SEEDS = [0, 1, 2]
SEED_FRACTION = 0.8
METHODS = [*hi.WINDOW_ORDER, "uniform5"]


def imp(spark: SparkSession, folder: str, first_day: int | None = None) -> DataFrame:
    return logs.events_log(spark, folder, first_day)


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts per campaign. The log is aggregated once per query; every later use reads the small table."""
    key = ("cells", folder)
    if key not in SHARED:
        SHARED[key] = settle(hi.cell_counts(imp(spark, folder), ["campaign"]))
    return SHARED[key]


def last_day(spark: SparkSession, folder: str) -> int:
    """The log's last day; one aggregation over the log's time column for each query."""
    key = ("last_day", folder)
    if key not in SHARED:
        SHARED[key] = logs.events_log(spark, folder).agg(F.max("day")).first()[0] or 0
    return SHARED[key]


def first_test(spark: SparkSession, folder: str) -> int:
    """First day of the locked test: the last share of the eligible days, at least one."""
    last = last_day(spark, folder)
    return last - max(1, round((last - WARMUP_DAYS) * TEST_FRAC)) + 1


def eligible(df: DataFrame) -> DataFrame:
    return df.filter(F.col("day") >= FIRST_ELIGIBLE)


def wide_cells(spark: SparkSession, folder: str, matured: bool = False) -> DataFrame:
    """Bank at cell level, eligible days: (campaign, day, n, clicks, one column per horizon)."""
    return eligible(hi.rate_bank(cells(spark, folder), ["campaign"], matured=matured))


def bank_rows(spark: SparkSession, folder: str, matured: bool = False) -> DataFrame:
    """Bank at row level: the log joined to the cell predictions of its day."""
    rates = hi.rate_bank(cells(spark, folder), ["campaign"], matured=matured)
    rates = rates.select("campaign", "day", *hi.WINDOW_ORDER)
    return attach(imp(spark, folder, FIRST_ELIGIBLE), rates, ["campaign", "day"], "inner")


def expert_tally(spark: SparkSession, folder: str, matured: bool = False) -> DataFrame:
    wide = wide_cells(spark, folder, matured)
    return hi.long_bank(wide, hi.WINDOW_ORDER, ["campaign", "day", "n", "clicks"])


def with_rates(counted: DataFrame, matured: bool = False) -> DataFrame:
    """Finer tallies of the eligible days with their campaign's rates; the log is aggregated once for both."""
    counted = settle(counted)
    rates = hi.rate_bank(hi.roll_up(counted, ["campaign"]), ["campaign"], matured=matured)
    return eligible(counted).join(rates.select("campaign", "day", *hi.WINDOW_ORDER), ["campaign", "day"])


def method_tally(spark: SparkSession, folder: str, **extra) -> DataFrame:
    """The five experts and their equal mix, as tallies per (method, day, campaign, extra columns)."""
    if extra:
        counted = hi.cell_counts(imp(spark, folder).withColumns(extra), ["campaign", *extra])
        wide = with_rates(counted)
    else:
        wide = wide_cells(spark, folder)
    wide = hi.uniform_mix(wide, hi.WINDOW_ORDER)
    keep = ["campaign", "day", "n", "clicks", *extra]
    return hi.long_bank(wide, METHODS, keep).withColumnRenamed("expert", "method")


def day_losses(tally: DataFrame, by: str = "expert", eps: float = sc.LOSS_CLIP) -> DataFrame:
    """(day, expert, ord, n, loss); ``key`` is the loss on a grid fine enough to break ties the same way anywhere."""
    loss = F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"), eps)) / F.sum("n")
    return tally.groupBy("day", by, "ord").agg(F.sum("n").alias("n"), loss.alias("loss")) \
        .withColumn("key", F.round("loss", 10))


def per_day(spark: SparkSession, folder: str) -> DataFrame:
    t = method_tally(spark, folder)
    n, k, p = F.col("n"), F.col("clicks"), F.col("p")
    return t.groupBy("method", "ord", "day").agg(
        F.sum("n").alias("n"), F.sum("clicks").alias("clicks"),
        (F.sum(sc.tally_loss(n, k, p)) / F.sum("n")).alias("log_loss"),
        (F.sum(sc.tally_brier(n, k, p)) / F.sum("n")).alias("brier"))


def seeded(df: DataFrame) -> DataFrame:
    """Three deterministic 80 % samples of the log, one per seed."""
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    return df.select("*", seeds).filter(hs.in_sample(F.col("seed"), F.col("row_id"), SEED_FRACTION))


def per_day_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Per-day losses of every method, per seed sample."""
    counted = hi.cell_counts(seeded(imp(spark, folder)), ["seed", "campaign"])
    wide = eligible(hi.rate_bank(counted, ["seed", "campaign"]))
    wide = hi.uniform_mix(wide, hi.WINDOW_ORDER)
    t = hi.long_bank(wide, METHODS, ["seed", "day", "n", "clicks"]).withColumnRenamed("expert", "method")
    n, k, p = F.col("n"), F.col("clicks"), F.col("p")
    return t.groupBy("seed", "method", "ord", "day").agg(
        F.sum("n").alias("n"), F.sum("clicks").alias("clicks"),
        (F.sum(sc.tally_loss(n, k, p)) / F.sum("n")).alias("log_loss"),
        (F.sum(sc.tally_brier(n, k, p)) / F.sum("n")).alias("brier"))
