"""Counterfactual replay of second-price auctions: what a prediction is worth at a given spend."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import hashing as hs
from tidelog.operators.quantiles import exact_quantiles
from tidelog.session import ensure_checkpoint_dir, literal_rows, running_total

N_SCALES = 40
TAILS = (0.001, 0.999)


def outcome_sums(won: Column | None = None) -> list[Column]:
    """Spend and value of the impressions that were won."""
    def total(v):
        return F.coalesce(F.sum(v if won is None else F.when(won, v)), F.lit(0))

    return [total(F.col("cost")).cast("double").alias("spend"), total(F.lit(1)).alias("impressions"),
            total(F.col("click")).alias("clicks"), total(F.col("conversion")).alias("conversions"),
            total(F.col("attribution")).alias("attributed"),
            total(F.col("cpo") * F.col("conversion")).cast("double").alias("cpo_value")]


VALUES = ["spend", "impressions", "clicks", "conversions", "attributed", "cpo_value"]


def linear_frontier(bids: DataFrame, keys: list[str], n_scales: int = N_SCALES) -> DataFrame:
    """Value-spend frontier of bidding scale * p, on a geometric grid of scales per key.

    A row is won at every scale from some index on. That index comes from one
    logarithm, so the log is aggregated once into at most n_scales + 1 rows per
    key, and the frontier is their running sum.
    """
    spark = bids.sparkSession
    safe = F.greatest(F.col("p"), F.lit(1e-12))
    priced = bids.withColumn("_ratio", F.col("cost") / safe)
    tails = exact_quantiles(priced, keys, "_ratio", list(TAILS))
    kinds = dict(bids.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["_lo double", "_hi double"])
    bounds = literal_rows(spark, [(*key, max(a, 1e-9), max(b, 1e-8)) for key, (a, b) in tails.items()], schema)
    rows = priced.join(F.broadcast(bounds), keys)

    def scale(i: Column) -> Column:
        return F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), i / float(n_scales - 1))

    def wins(i: Column) -> Column:
        return scale(i) * F.col("p") >= F.col("cost")

    step = F.log(F.col("_hi") / F.col("_lo")) / float(n_scales - 1)
    guess = F.ceil(F.log(F.col("_ratio") / F.col("_lo")) / F.when(step > 0, step).otherwise(1.0))
    rows = rows.withColumn("_g", F.greatest(F.lit(0), F.least(guess, F.lit(n_scales - 1))))
    g = F.col("_g")
    first = (F.when((g > 0) & wins(g - 1), g - 1).when(wins(g), g)
             .when((g < n_scales - 1) & wins(g + 1), g + 1).otherwise(F.lit(n_scales)))
    steps = rows.groupBy(*keys, first.alias("step")).agg(*outcome_sums())
    size = steps.groupBy(*keys).agg(F.sum("impressions").alias("_n"))
    grid = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_scales - 1))).alias("step"))
    grid = grid.withColumn("scale", scale(F.col("step"))).drop("_lo", "_hi")
    upto = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(steps, [*keys, "step"], "left")
    sums = full.select(*keys, "step", "scale", *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(v) for v in VALUES])
    out = sums.join(size, keys)
    return out.select(*keys, "step", "scale", *VALUES, (F.col("impressions") / F.col("_n")).alias("win_rate"),
                      F.when(F.col("spend") > 0, F.col("clicks") / F.col("spend") / 1000).otherwise(0.0)
                      .alias("clicks_per_kilo_spend"))


def ranked_by_efficiency(bids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their cumulative cost when a day's impressions are taken by p / cost, ties by row id.

    The cumulative cost is a distributed running sum: a day may be larger than a task.
    """
    eff = F.col("p") / F.greatest(F.col("cost"), F.lit(1e-12))
    rows = bids.withColumn("_eff", eff)
    return running_total(rows, [*keys, "day"], [F.col("_eff").desc(), F.col("row_id")], {"cum_cost": "cost"})


def daily_allowance(bids: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """Budget = fraction of the cost of all impressions, spread evenly over the days: (keys, budget, allowance)."""
    per_day = bids.groupBy(*keys, "day").agg(F.sum("cost").alias("_c"))
    return per_day.groupBy(*keys).agg((F.sum("_c") * fraction).alias("budget"),
                                      (F.sum("_c") * fraction / F.count("*")).alias("allowance"))


def paced_auction(ranked: DataFrame, keys: list[str], allowance: DataFrame) -> DataFrame:
    """Per-day result without carry-over: (keys, day, outcome sums, allowance_after)."""
    for_day = ranked.join(allowance, keys)
    won = F.col("cum_cost") <= F.col("allowance")
    return for_day.groupBy(*keys, "day", "allowance").agg(*outcome_sums(won)).withColumn(
        "allowance_after", F.col("allowance") - F.col("spend")).drop("allowance")


def paced_auction_carry(ranked: DataFrame, keys: list[str], allowance: DataFrame) -> DataFrame:
    """Unspent allowance moves to the next day.

    The ranked table is written once by day; every day then reads only its own
    partition and only the prefix that can still be paid for. The driver carries
    one number per key.
    """
    spark = ranked.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/ranked-{uuid.uuid4().hex}"
    ranked.write.partitionBy("day").parquet(path)
    table = spark.read.parquet(path)
    kinds = dict(ranked.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["_left double"])
    per_day = {tuple(r[k] for k in keys): r["allowance"] for r in allowance.collect()}
    left = {key: 0.0 for key in per_day}
    days = sorted(r["day"] for r in table.select("day").distinct().collect())
    out = []
    for day in days:
        now = {key: left[key] + per_day[key] for key in per_day}
        limits = literal_rows(spark, [(*key, v) for key, v in now.items()], schema)
        prefix = table.filter((F.col("day") == day) & (F.col("cum_cost") <= max(now.values())))
        won = prefix.join(F.broadcast(limits), keys).filter(F.col("cum_cost") <= F.col("_left"))
        spent = {tuple(r[k] for k in keys): r for r in won.groupBy(*keys).agg(*outcome_sums()).collect()}
        for key in per_day:
            r = spent.get(key)
            used = [r[v] for v in VALUES] if r else [0.0, 0, 0, 0, 0, 0.0]
            left[key] = now[key] - used[0]
            out.append((*key, int(day), *used, left[key]))
    columns = [f"{k} {kinds[k]}" for k in keys] + ["day int", "spend double", "impressions long", "clicks long",
                                                   "conversions long", "attributed long", "cpo_value double",
                                                   "allowance_after double"]
    return literal_rows(spark, out, ", ".join(columns))


def paced_summary(days: DataFrame, keys: list[str], allowance: DataFrame) -> DataFrame:
    totals = days.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in VALUES]).join(allowance, keys)
    return totals.select(*keys, *VALUES, "budget",
                         F.try_divide(F.col("spend"), F.col("budget")).alias("budget_used"),
                         F.greatest(F.lit(0.0), F.col("spend") - F.col("budget")).alias("violation"))


def _brackets(frontier: DataFrame, keys: list[str]) -> DataFrame:
    """Frontier points with the next point of higher spend; equal spends keep their last value."""
    w = Window.partitionBy(*keys).orderBy("spend", "step")
    points = frontier.withColumns({"_ns": F.lead("spend").over(w), "_nv": F.lead("clicks").over(w)})
    return points.filter(F.col("_ns").isNull() | (F.col("_ns") > F.col("spend")))


def value_at_spend(frontier: DataFrame, keys: list[str], targets: DataFrame, clamp_left: bool = False) -> DataFrame:
    """Clicks interpolated at each target spend: (keys, target..., clicks, lo, hi).

    Right of the frontier the last value holds; left of it the value is null, or
    the first one when ``clamp_left``. ``targets``: (keys or nothing, target).
    """
    on = [k for k in keys if k in targets.columns]
    ends = frontier.groupBy(*keys).agg(F.min("spend").alias("_min"), F.min_by("clicks", "step").alias("_first"))
    points = _brackets(frontier, keys).join(ends, keys)
    goals = points.join(F.broadcast(targets), on) if on else points.crossJoin(F.broadcast(targets))
    t = F.col("target")
    inside = goals.filter((F.col("spend") <= t) & (F.col("_ns").isNull() | (F.col("_ns") > t)))
    slope = (F.col("_nv") - F.col("clicks")) / (F.col("_ns") - F.col("spend"))
    value = F.when(F.col("_ns").isNull(), F.col("clicks").cast("double")).otherwise(
        F.col("clicks") + slope * (t - F.col("spend")))
    hit = inside.select(*keys, *[c for c in targets.columns if c not in keys], value.alias("clicks_at"),
                        F.col("spend").alias("lo"), F.coalesce("_ns", "spend").alias("hi"))
    every = ends.join(F.broadcast(targets), on) if on else ends.crossJoin(F.broadcast(targets))
    joined = every.join(hit, [*keys, *[c for c in targets.columns if c not in keys]], "left")
    first = F.when(F.lit(clamp_left), F.col("_first").cast("double"))
    return joined.select(*keys, *[c for c in targets.columns if c not in keys],
                         F.coalesce("clicks_at", first).alias("clicks_at"),
                         F.coalesce("lo", "_min").alias("lo"), F.coalesce("hi", "_min").alias("hi"))


def reference_bidders(bids: DataFrame, seed: int = 0) -> DataFrame:
    """Anchors: perfect foresight, the constant base rate, and one model's predictions dealt out at random."""
    rate = bids.agg(F.avg("click").alias("_rate"))
    perfect = bids.withColumn("p", F.col("click").cast("double")).withColumn("bidder", F.lit("perfect"))
    constant = bids.crossJoin(rate).withColumn("p", F.col("_rate")).drop("_rate").withColumn("bidder", F.lit("no_skill"))
    one = F.lit(1).cast("long")
    slots = running_total(bids.drop("p").withColumn("_one", one), [], [F.col("row_id")], {"_r": "_one"}).drop("_one")
    mixed = hs.md5_int(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))
    deck = bids.select(mixed.alias("_h"), F.col("row_id").alias("_from"), "p").withColumn("_one", one)
    dealt = running_total(deck, [], [F.col("_h"), F.col("_from")], {"_r": "_one"}).select("_r", "p")
    shuffled = slots.join(dealt, "_r").drop("_r").withColumn("bidder", F.lit("shuffled"))
    return perfect.unionByName(constant).unionByName(shuffled)
