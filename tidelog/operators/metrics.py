"""Prediction quality on tallies.

A tally row says "n impressions with this prediction had this many clicks".
Row-level records are tallies with n = 1, so each operator takes both; where
predictions repeat, the tally is what gets shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.session import running_total

ECE_BINS = 15


def from_records(records: DataFrame) -> DataFrame:
    return records.withColumn("n", F.lit(1).cast("long")).withColumn("clicks", F.col("y").cast("long"))


def mean_losses(tally: DataFrame, keys: list[str]) -> DataFrame:
    """n, clicks, log loss and Brier score per key; one partial aggregation."""
    n, k, p = F.col("n"), F.col("clicks"), F.col("p")
    return tally.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("clicks").alias("clicks"),
        (F.sum(sc.tally_loss(n, k, p)) / F.sum("n")).alias("log_loss"),
        (F.sum(sc.tally_brier(n, k, p)) / F.sum("n")).alias("brier"))


def calibration_error(tally: DataFrame, keys: list[str], bins: int = ECE_BINS) -> DataFrame:
    """Equal-width expected calibration error."""
    bin_id = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per_bin = tally.withColumn("_bin", bin_id).groupBy(*keys, "_bin").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("p")).alias("_p"), F.sum("clicks").alias("_k"))
    return per_bin.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("_p") - F.col("_k"))) / F.sum("_n")).alias("ece"))


def _by_score(tally: DataFrame, keys: list[str]) -> DataFrame:
    return tally.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("clicks").alias("clicks"))


def _ranked(tally: DataFrame, keys: list[str], exact_slices: bool) -> DataFrame:
    """Distinct scores with running counts from the highest score down (inclusive)."""
    scores = _by_score(tally, keys)
    if exact_slices:
        return running_total(scores, keys, [F.col("p").desc()], {"n_above": "n", "k_above": "clicks"})
    # Two levels: running sums inside 1/1024-wide score slices, plus the totals of the slices above.
    sliced = scores.withColumn("_slice", F.floor(F.col("p") * 1024))
    inside = Window.partitionBy(*keys, "_slice").orderBy(F.col("p").desc())
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_sn"), F.sum("clicks").alias("_sk"))
    above = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", F.coalesce(F.sum("_sn").over(above), F.lit(0)).alias("_on"),
                           F.coalesce(F.sum("_sk").over(above), F.lit(0)).alias("_ok"))
    return (sliced.withColumn("n_above", F.sum("n").over(inside)).withColumn("k_above", F.sum("clicks").over(inside))
            .join(totals, [*keys, "_slice"])
            .withColumn("n_above", F.col("n_above") + F.col("_on"))
            .withColumn("k_above", F.col("k_above") + F.col("_ok"))
            .drop("_slice", "_on", "_ok"))


def ranking_metrics(tally: DataFrame, keys: list[str], exact_slices: bool = False) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null when one class is missing.

    ``exact_slices`` range-partitions the distinct scores, for days whose scores
    hardly repeat and crowd into a narrow range.
    """
    r = _ranked(tally, keys, exact_slices)
    neg = F.col("n") - F.col("clicks")
    neg_above = F.col("n_above") - F.col("k_above")
    k_strict = F.col("k_above") - F.col("clicks")
    # each negative at this score loses to the positives above it, and half of those level with it
    won = neg * (k_strict + F.col("clicks") / 2.0)
    precision = F.col("k_above") / F.col("n_above")
    agg = r.groupBy(*keys).agg(
        F.sum("clicks").alias("_k"), F.max(neg_above).alias("_neg"),
        F.sum(won).alias("_won"), F.sum(F.col("clicks") * precision).alias("_ap"))
    both = (F.col("_k") > 0) & (F.col("_neg") > 0)
    return agg.select(*keys, F.when(both, F.col("_won") / (F.col("_k") * F.col("_neg"))).alias("roc_auc"),
                      F.when(both, F.col("_ap") / F.col("_k")).alias("pr_auc"))


def day_metrics(tally: DataFrame, keys: list[str]) -> DataFrame:
    return (mean_losses(tally, keys).join(calibration_error(tally, keys), keys)
            .join(ranking_metrics(tally, keys), keys))


def with_overall(tally: DataFrame, keys: list[str], group: str, label: str = "overall") -> DataFrame:
    """Losses per (keys, group) and over all groups, from one pass (grouping sets)."""
    n, k, p = F.col("n"), F.col("clicks"), F.col("p")
    sets = [[*[F.col(c) for c in keys], F.col(group)], [F.col(c) for c in keys]]
    out = tally.groupingSets(sets, *keys, group).agg(
        F.sum("n").alias("n"), F.sum("clicks").alias("clicks"),
        (F.sum(sc.tally_loss(n, k, p)) / F.sum("n")).alias("log_loss"),
        (F.sum(sc.tally_brier(n, k, p)) / F.sum("n")).alias("brier"))
    return out.withColumn(group, F.coalesce(F.col(group), F.lit(label)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows where both are present and finite; null when there is none."""
    ok = value.isNotNull() & ~F.isnan(value) & weight.isNotNull()
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def comparison(per_day: DataFrame, by: list[str]) -> DataFrame:
    return per_day.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("days"),
        weighted_mean(F.col("log_loss"), F.col("n")).alias("log_loss"),
        weighted_mean(F.col("brier"), F.col("n")).alias("brier"),
        F.avg("pr_auc").alias("pr_auc"), F.avg("roc_auc").alias("roc_auc"))


def pooled_and_daily(per_day: DataFrame, by: list[str]) -> DataFrame:
    return per_day.groupBy(*by).agg(
        weighted_mean(F.col("log_loss"), F.col("n")).alias("iw_log_loss"),
        F.avg("log_loss").alias("daily_mean"), F.max("log_loss").alias("worst_day"),
        F.percentile("log_loss", F.lit(0.5)).alias("median_day"))


def seed_mean(per_seed: DataFrame, by: list[str]) -> DataFrame:
    return per_seed.groupBy(*by).agg(
        F.avg("log_loss").alias("mean_loss"), F.stddev_samp("log_loss").alias("sd_loss"),
        F.avg("n").alias("mean_n"), F.countDistinct("seed").alias("n_seeds"))


def mean_and_se(value: str) -> list[Column]:
    v = F.col(value)
    return [F.avg(v).alias(f"{value}_mean"),
            (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{value}_se")]


def logit_margins(tally: DataFrame, keys: list[str]) -> DataFrame:
    """Separation of the classes on the logit scale, and how extreme the logits get."""
    z = sc.logit(F.col("p"))
    neg = F.col("n") - F.col("clicks")
    return tally.groupBy(*keys).agg(
        (F.try_divide(F.sum(F.col("clicks") * z), F.sum("clicks"))
         - F.try_divide(F.sum(neg * z), F.sum(neg))).alias("margin"),
        F.max(F.abs(z)).alias("max_abs_logit"),
        (F.sum(F.col("n") * F.abs(z)) / F.sum("n")).alias("mean_abs_logit"))


def keep_last(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Append a newer table and keep, per key, the newest row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    newest = Window.partitionBy(*key).orderBy(F.col("_v").desc())
    return both.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_v", "_r")
