"""Statistics whose unit is the day. Inputs hold one value per (key, day), so a key's values fit an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import hashing as hs


def _mean(v: Column) -> Column:
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), F.size(v))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def day_arrays(df: DataFrame, keys: list[str], values: list[str], order: str = "day") -> DataFrame:
    """One row per key: arrays of the values in day order, and their length ``_m``."""
    usable = df
    for v in values:
        usable = usable.filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    seq = F.sort_array(F.collect_list(F.struct(order, *[F.col(v).cast("double").alias(v) for v in values])))
    grouped = usable.groupBy(*keys).agg(seq.alias("_s")) if keys else usable.agg(seq.alias("_s"))
    return grouped.select(*keys, *[F.col("_s").getField(v).alias(v) for v in values],
                          F.size("_s").alias("_m"))


def draw(boot: Column, j: Column, size: Column) -> Column:
    """Index drawn for position j of resample ``boot``; md5 keeps it the same everywhere."""
    return (hs.md5_int(F.concat_ws(":", boot.cast("string"), j.cast("string"))) % size).cast("int")


def _resamples(arrays: DataFrame, n_boot: int) -> DataFrame:
    return arrays.filter("_m > 0").crossJoin(arrays.sparkSession.range(n_boot).withColumnRenamed("id", "_boot"))


def _pick(values: str) -> Column:
    spots = F.sequence(F.lit(0), F.col("_m") - 1)
    return F.transform(spots, lambda j: F.element_at(values, draw(F.col("_boot"), j, F.col("_m")) + 1))


def _interval(boots: DataFrame, keys: list[str], stat: str) -> DataFrame:
    lo, hi = F.percentile(stat, F.lit(0.025)).alias("lo"), F.percentile(stat, F.lit(0.975)).alias("hi")
    return boots.groupBy(*keys).agg(lo, hi) if keys else boots.agg(lo, hi)


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return a.join(b, keys, how) if keys else a.crossJoin(b)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str = "delta", n_boot: int = 1000) -> DataFrame:
    """Mean over days and its percentile interval under resampling of whole days."""
    arrays = day_arrays(df, keys, [value])
    boots = _resamples(arrays, n_boot).select(*keys, _mean(_pick(value)).alias("_stat"))
    point = arrays.select(*keys, F.col("_m").alias("days"), _mean(F.col(value)).alias("mean"))
    return _join(point, _interval(boots, keys, "_stat"), keys)


def bootstrap_ratio(df: DataFrame, keys: list[str], num: str, den: str, n_boot: int = 1000) -> DataFrame:
    """Ratio of sums with whole days resampled; numerator and denominator share the draws."""
    arrays = day_arrays(df, keys, [num, den])
    boots = _resamples(arrays, n_boot).select(
        *keys, F.try_divide(_sum(_pick(num)), _sum(_pick(den))).alias("_stat"))
    point = arrays.select(*keys, F.col("_m").alias("days"),
                          F.try_divide(_sum(F.col(num)), _sum(F.col(den))).alias("ratio"))
    return _join(point, _interval(boots, keys, "_stat"), keys)


def bootstrap_weighted(df: DataFrame, keys: list[str], value: str, weight: str, n_boot: int = 1000) -> DataFrame:
    product = df.withColumn("_vw", F.col(value) * F.col(weight))
    return bootstrap_ratio(product, keys, "_vw", weight, n_boot).withColumnRenamed("ratio", "mean")


def bootstrap_blocks(df: DataFrame, keys: list[str], value: str = "delta", block: int = 2,
                     n_boot: int = 1000) -> DataFrame:
    """Moving-block bootstrap of consecutive days; null bounds below two blocks."""
    arrays = day_arrays(df, keys, [value])
    enough = arrays.filter(F.col("_m") >= 2 * block)
    n_starts = F.col("_m") - block + 1
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("_m") / block).cast("int") - 1),
                         lambda j: draw(F.col("_boot"), j, n_starts))
    taken = F.slice(F.flatten(F.transform(starts, lambda s: F.slice(F.col(value), s + 1, block))), F.lit(1), F.col("_m"))
    boots = _resamples(enough, n_boot).select(*keys, _mean(taken).alias("_stat"))
    point = arrays.select(*keys, F.col("_m").alias("days"), _mean(F.col(value)).alias("mean"))
    interval = _interval(boots, keys, "_stat")
    return _join(point, interval, keys)


def leave_one_out(df: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """Mean of the other days, per day; null for a single day."""
    w = Window.partitionBy(*keys)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return df.select(*keys, "day", F.try_divide(total - F.col(value), n - 1).alias("loo"), (total / n).alias("mean"))


def leave_one_out_range(df: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    loo = leave_one_out(df, keys, value)
    flips = F.max((F.signum("loo") != F.signum("mean")).cast("int")) == 1
    return loo.groupBy(*keys).agg(F.min("loo").alias("loo_min"), F.max("loo").alias("loo_max"),
                                  flips.alias("reverses"))


def binomial_cdf(k: Column, n: Column) -> Column:
    """P(X <= k) for a fair coin, summed in log space."""
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lt"), F.lit(0.0).alias("s"))

    def step(acc, i):
        return F.struct((acc["lt"] + F.when(i < n, F.log((n - i) / (i + 1.0))).otherwise(0.0)).alias("lt"),
                        (acc["s"] + F.exp(acc["lt"])).alias("s"))

    total = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step, lambda a: a["s"])
    return F.when(k < 0, F.lit(0.0)).otherwise(total)


def sign_tests(wins: Column, n: Column) -> dict[str, Column]:
    """Exact two-sided and one-sided (at least this many wins) p values, and the smallest possible one."""
    few = F.least(wins, n - wins)
    return {
        "p_two_sided": F.when(n > 0, F.least(F.lit(1.0), 2.0 * binomial_cdf(few, n))),
        "p_one_sided": F.when(n > 0, 1.0 - F.when(wins > 0, binomial_cdf(F.greatest(wins - 1, F.lit(0)), n)).otherwise(0.0)),
        "p_floor": F.when(n > 0, F.least(F.lit(1.0), F.pow(F.lit(2.0), 1 - n))),
    }


def win_counts(df: DataFrame, keys: list[str], value: str = "delta", tie: float = 1e-9) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count("*").alias("days"), F.count_if(v < -tie).alias("won"), F.count_if(v > tie).alias("lost"),
        F.count_if(F.abs(v) <= tie).alias("tied"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail probability of |z| from a series with positive terms only."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    start = F.struct((2.0 * x / F.sqrt(F.lit(3.141592653589793))).alias("t"), F.lit(0.0).alias("s"))

    def step(acc, i):
        return F.struct((acc["t"] * 2.0 * x * x / (2.0 * i + 3.0)).alias("t"), (acc["s"] + acc["t"]).alias("s"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(119)), start, step, lambda a: a["s"])
    return F.greatest(F.lit(0.0), 1.0 - F.exp(-x * x) * series)


EXACT_RANK_LIMIT = 50


def signed_rank(df: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """Two-sided signed-rank test. Zeros are dropped; exact null distribution without zeros, ties and
    beyond 50 values the normal approximation."""
    nz = df.filter(F.abs(F.col(value)) > 0)
    by_size = Window.partitionBy(*keys).orderBy(F.abs(F.col(value)))
    level = Window.partitionBy(*keys, F.abs(F.col(value)))
    ranked = nz.withColumn("_t", F.count("*").over(level)).withColumn(
        "_r", F.rank().over(by_size) + (F.col("_t") - 1) / 2.0)
    stats = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col(value) > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col(value) < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"),
        F.max("_t").alias("_ties"), F.sum(F.col("_t") * F.col("_t") - 1.0).alias("_tc"))
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    s = stats.join(total, keys)
    exact = (F.col("_ties") == 1) & (F.col("n") == F.col("_all")) & (F.col("n") <= EXACT_RANK_LIMIT)
    top = (F.col("n") * (F.col("n") + 1) / 2).cast("int")
    zero = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def add(dist, k):
        return F.transform(dist, lambda c, i: c + F.when(i >= k, F.get(dist, i - k)).otherwise(0.0))

    dist = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), zero, add)
    w = F.least("w_plus", "w_minus")
    tail = F.aggregate(F.slice(dist, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    p_exact = F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), F.col("n")))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("_tc") / 48.0
    p_normal = normal_tail((w - F.col("n") * (F.col("n") + 1) / 4.0) / F.sqrt(var))
    return s.select(*keys, "n", "w_plus", "w_minus", exact.alias("exact"),
                    F.when(exact, p_exact).otherwise(p_normal).alias("p"))


def holm(df: DataFrame, keys: list[str], name: str, p: str = "p") -> DataFrame:
    """Step-down adjusted p values within each key."""
    order = Window.partitionBy(*keys).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*keys))
    step = df.withColumn("_a", (m - F.row_number().over(order) + 1) * F.col(p))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_a").over(run))).drop("_a")


def pooled_effect(df: DataFrame, keys: list[str], value: str = "delta", weight: str = "n") -> DataFrame:
    """Effect pooled by day size beside the equal-day mean."""
    v, w = F.col(value), F.col(weight)
    return df.groupBy(*keys).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias("pooled"), F.avg(v).alias("daily"))


def summary(df: DataFrame, keys: list[str], value: str = "delta", n_boot: int = 1000) -> DataFrame:
    """Everything about a series of daily differences in one row per key."""
    boot = bootstrap_mean(df, keys, value, n_boot)
    blocks = bootstrap_blocks(df, keys, value, 2, n_boot).select(*keys, F.col("lo").alias("mbb_lo"), F.col("hi").alias("mbb_hi"))
    v = F.col(value)
    basics = df.groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("worst"),
                                   F.count_if(v < 0).alias("won"), F.count("*").alias("_n"))
    tests = sign_tests(F.col("won"), F.col("_n"))
    basics = basics.withColumn("sign_p", tests["p_two_sided"]).drop("_n")
    return (boot.join(blocks, keys).join(basics, keys).join(leave_one_out_range(df, keys, value), keys))
