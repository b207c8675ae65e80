"""Hindsight diagnostics on day-level tables. They use today's labels and must never feed a prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.history import NOMINAL_DAYS
from tidelog.session import literal_rows

# Losses closer than this are a tie; the listed order of the experts then decides.
TIE_DIGITS = 10


def ranked_key(loss: str = "loss") -> Column:
    return F.round(F.col(loss), TIE_DIGITS)


def best_per(losses: DataFrame, keys: list[str], name: str = "expert", loss: str = "loss") -> DataFrame:
    """Lowest loss per key; ties go to the expert listed first."""
    pick = F.min_by(F.struct(F.col(name), F.col(loss)), F.struct(ranked_key(loss), F.col("ord")))
    return losses.groupBy(*keys).agg(pick.alias("_b")).select(*keys, f"_b.{name}", f"_b.{loss}")


def nominal_days(name: Column) -> Column:
    pairs = [x for k, v in NOMINAL_DAYS.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), name)


def adaptation(excess: DataFrame, shift_days: list[int], horizon: int, tol: float, patience: int) -> DataFrame:
    """Mean and max excess over the oracle; after each shift the peak, the regret and the recovery day."""
    spark = excess.sparkSession
    overall = excess.groupBy("method").agg(F.avg("excess").alias("mean_excess"), F.max("excess").alias("max_excess"))
    shifts = literal_rows(spark, [(s,) for s in shift_days], "shift int")
    after = excess.join(F.broadcast(shifts), (F.col("day") >= F.col("shift")) &
                        (F.col("day") <= F.col("shift") + horizon))
    run = Window.partitionBy("method", "shift").orderBy("day").rowsBetween(0, patience - 1)
    calm = (F.max("excess").over(run) <= tol) & (F.count("excess").over(run) == patience)
    per_shift = after.withColumn("_start", F.when(calm, F.col("day"))).groupBy("method", "shift").agg(
        F.max("excess").alias("peak"), F.sum("excess").alias("regret"),
        (F.min("_start") - F.col("shift")).alias("recovery"))
    summary = per_shift.groupBy("method").agg(
        F.avg("peak").alias("peak"), F.avg("regret").alias("regret"), F.avg("recovery").alias("recovery"))
    return overall.join(summary, "method", "left")


def residual_runs(blocks: DataFrame) -> DataFrame:
    """Per day: longest run of residuals of one sign, and their lag-1 correlation.

    ``blocks`` holds one row per (day, block) with ``residual``.
    """
    w = Window.partitionBy("day").orderBy("block")
    s = blocks.withColumn("_sign", F.signum("residual")).withColumn("_prev", F.lag("residual").over(w))
    changed = (F.col("_sign") != F.lag("_sign").over(w)) | (F.col("_sign") == 0)
    s = s.withColumn("_run", F.sum(F.coalesce(changed.cast("int"), F.lit(1))).over(w))
    runs = s.groupBy("day", "_run").agg(F.count("*").alias("_len")).groupBy("day").agg(
        F.max("_len").alias("longest_run"))
    corr = s.groupBy("day").agg(F.count("*").alias("n_blocks"), F.corr("residual", "_prev").alias("_c"))
    return corr.join(runs, "day").select(
        "day", "longest_run", "n_blocks", F.when(F.col("n_blocks") > 2, F.col("_c")).alias("autocorr"))


def weight_movement(weights: DataFrame) -> DataFrame:
    """Per day: L1 change of the expert weights against the previous day, and the effective horizon."""
    w = Window.partitionBy("expert").orderBy("day")
    moved = weights.withColumn("_move", F.abs(F.col("w") - F.lag("w").over(w)))
    return moved.groupBy("day").agg(
        F.sum("_move").alias("move"), F.sum(F.col("w") * nominal_days(F.col("expert"))).alias("horizon"))


def paired(per_day: DataFrame, method: str, baseline: str, keys: list[str] | None = None) -> DataFrame:
    """Daily loss difference method - baseline on the days both have."""
    keys = [*(keys or []), "day"]
    a = per_day.filter(F.col("method") == method).select(*keys, "n", F.col("log_loss").alias("_a"))
    b = per_day.filter(F.col("method") == baseline).select(*keys, F.col("log_loss").alias("_b"))
    return a.join(b, keys).select(*keys, "n", F.col("_a").alias("loss_a"), F.col("_b").alias("loss_b"),
                                  (F.col("_a") - F.col("_b")).alias("delta"))


def captured_gain(losses: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Regret against the oracle and the share of the possible gain that was captured.

    ``losses``: one row per day with l_method, l_long, l_oracle. Days whose
    possible gain is below ``floor`` are flagged and get no share.
    """
    room = F.col("l_long") - F.col("l_oracle")
    return losses.select(
        "day", (F.col("l_method") - F.col("l_oracle")).alias("regret"),
        F.when(room >= floor, (F.col("l_long") - F.col("l_method")) / room).alias("captured"),
        (room < floor).alias("negligible"))
