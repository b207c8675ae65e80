"""Choosing and mixing experts day by day from matured losses only.

All state lives on day-level tables (one row per calendar day and expert).
Sequential rules are ordered folds that emit the state *before* the update, so
the weights of a day never contain that day's labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.operators.history import WINDOW_ORDER
from tidelog.session import literal_rows

# Switching rates of the sub-algorithms.
SWITCH_RATES = [0.0, 0.001, 0.01, 0.05, 0.1, 0.2, 0.4]


def day_vectors(day_values: DataFrame, keys: list[str], value: str = "loss") -> DataFrame:
    """(keys, day, x): the experts' values of a day as one array in registry order."""
    cells = F.sort_array(F.collect_list(F.struct("ord", value)))
    return day_values.groupBy(*keys, "day").agg(cells.getField(value).alias("x"))


def fold_weights(vectors: DataFrame, keys: list[str], k: int, update) -> DataFrame:
    """Ordered fold over days; returns (keys, day, w) with the weights used on that day.

    ``update(w, x, row)`` builds the next weights from the current ones, the
    day's vector and the key columns.
    """
    seq = F.sort_array(F.collect_list(F.struct("day", "x")))
    grouped = vectors.groupBy(*keys).agg(seq.alias("_seq")) if keys else vectors.agg(seq.alias("_seq"))
    start = F.array(*[F.lit(1.0 / k)] * k)
    zero = F.struct(start.alias("w"), F.expr(
        "cast(array() as array<struct<day:int,w:array<double>>>)").alias("path"))

    def step(acc, x):
        used = F.struct(x["day"].alias("day"), acc["w"].alias("w"))
        return F.struct(update(acc["w"], x["x"]).alias("w"), F.concat(acc["path"], F.array(used)).alias("path"))

    return grouped.select(*keys, F.inline(F.aggregate("_seq", zero, step, lambda a: a["path"])))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def softmax_of_loss(x: Column, eta: Column | float = 1.0) -> Column:
    raw = F.transform(x, lambda v: F.exp(-eta * (v - F.array_min(x))))
    return _let(raw, lambda r: F.transform(r, lambda v: v / _total(r)))


def ema(lam: float):
    return lambda w, x: F.zip_with(w, x, lambda a, b: lam * a + (1.0 - lam) * b)


def share(eta: Column | float, alpha: Column | float, k: int):
    """Exponential-weights step, then ``alpha`` of the mass back to uniform."""
    def update(w, x):
        raw = F.zip_with(w, x, lambda a, v: a * F.exp(-eta * (v - F.array_min(x))))
        return _let(raw, lambda r: F.transform(r, lambda v: (1.0 - alpha) * v / _total(r) + alpha / k))
    return update


def correctness_shares(wide: DataFrame, experts: list[str]) -> DataFrame:
    """Daily mean of each expert's share of the row's total correctness (tallies in, long day table out)."""
    up = sum((F.col(e) for e in experts), F.lit(0.0))
    down = sum((1.0 - F.col(e) for e in experts), F.lit(0.0))
    missed = F.col("n") - F.col("clicks")
    daily = wide.groupBy("day").agg(F.sum("n").alias("_n"), *[
        F.sum(F.col("clicks") * F.col(e) / up + missed * (1.0 - F.col(e)) / down).alias(e) for e in experts])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), (F.col(e) / F.col("_n")).alias("loss"))
                     for i, e in enumerate(experts)])
    return daily.select("day", F.inline(rows))


def ema_of_shares(shares: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    return fold_weights(day_vectors(shares, []), [], k, ema(lam))


def ema_of_softmax(losses: DataFrame, k: int, lam: float) -> DataFrame:
    targets = day_vectors(losses, []).withColumn("x", softmax_of_loss(F.col("x")))
    return fold_weights(targets, [], k, ema(lam))


def fixed_share(losses: DataFrame, k: int, eta: float = 2.0, alpha: float = 0.08) -> DataFrame:
    return fold_weights(day_vectors(losses, []), [], k, share(eta, alpha, k))


def switch_grid(losses: DataFrame, k: int, eta: float = 2.0, rates: list[float] = SWITCH_RATES) -> DataFrame:
    """One share path per switching rate, all in one fold job: (sub, alpha, day, w)."""
    grid = literal_rows(losses.sparkSession, list(enumerate(rates)), "sub int, alpha double")
    vectors = day_vectors(losses, []).crossJoin(F.broadcast(grid))
    return fold_weights(vectors, ["sub", "alpha"], k, share(eta, F.col("alpha"), k))


def learn_switch_rate(wide: DataFrame, losses: DataFrame, experts: list[str], eta: float = 2.0,
                      rates: list[float] = SWITCH_RATES) -> DataFrame:
    """Top-level exponential weights over the switching rates: (day, w, mean_alpha)."""
    k = len(experts)
    subs = switch_grid(losses, k, eta, rates)
    mixed = mix(wide, subs, experts, "p")
    sub_loss = mixed.groupBy("day", "sub").agg(
        (F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))) / F.sum("n")).alias("loss"))
    top = fold_weights(day_vectors(sub_loss.withColumnRenamed("sub", "ord"), []), [], len(rates),
                       share(eta, 0.0, len(rates))).withColumnRenamed("w", "v")
    parts = subs.join(top, "day").withColumn("_v", F.element_at("v", F.col("sub") + 1))
    summed = parts.groupBy("day").agg(
        F.sum(F.col("_v") * F.col("alpha")).alias("mean_alpha"),
        *[F.sum(F.col("_v") * F.col("w")[i]).alias(f"_w{i}") for i in range(k)])
    return summed.select("day", "mean_alpha", F.array(*[F.col(f"_w{i}") for i in range(k)]).alias("w"))


def discounted_weights(losses: DataFrame, configs: DataFrame, experts: list[str] = WINDOW_ORDER) -> DataFrame:
    """Weights exp(-eta * half-life-discounted past loss), for every (eta, half_life) row of ``configs``."""
    past = losses.select(F.col("day").alias("e"), "expert", "ord", "loss")
    days = losses.select("day").distinct()
    grid = days.crossJoin(F.broadcast(configs))
    fade = sc.age_weight(F.col("day") - F.col("e"), F.col("half_life"))
    seen = grid.join(past, F.col("e") < F.col("day")).groupBy(*grid.columns, "expert", "ord").agg(
        (F.sum(fade * F.col("loss")) / F.sum(fade)).alias("loss"))
    vectors = seen.groupBy(*grid.columns).agg(
        F.sort_array(F.collect_list(F.struct("ord", "loss"))).getField("loss").alias("x"))
    k = len(experts)
    weights = vectors.select(*grid.columns, softmax_of_loss(F.col("x"), F.col("eta")).alias("w"))
    return grid.join(weights, grid.columns, "left").withColumn(
        "w", F.coalesce("w", F.array(*[F.lit(1.0 / k)] * k)))


def weights_long(weights: DataFrame, experts: list[str], keep: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(i).alias("ord"), F.col("w")[i].alias("w"))
                     for i, e in enumerate(experts)])
    return weights.select(*keep, F.inline(rows))


def mix(wide: DataFrame, weights: DataFrame, experts: list[str], out: str) -> DataFrame:
    """Predictions of the day mixed with that day's weights (the weight table is one row per day and config)."""
    p = sum((F.col("w")[i] * F.col(e) for i, e in enumerate(experts)), F.lit(0.0))
    return wide.join(weights, "day").withColumn(out, p)


def blend_grid(wide: DataFrame, short: str, long: str, steps: int = 11) -> DataFrame:
    """Summed loss of (1 - a) * long + a * short per (day, a) for a grid of a: (day, alpha, n, s)."""
    alphas = [round(i / (steps - 1), 2) for i in range(steps)]
    grid = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    p = (1.0 - F.col("alpha")) * F.col(long) + F.col("alpha") * F.col(short)
    return wide.select("*", grid).groupBy("day", "alpha").agg(
        F.sum("n").alias("n"), F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), p)).alias("s"))


def global_blend(grid: DataFrame, window: int = 3) -> DataFrame:
    """Per day the blend with the lowest loss on the last ``window`` matured days, the hindsight best, the headroom."""
    recent = Window.partitionBy("alpha").orderBy("day").rowsBetween(-window, -1)
    scored = grid.withColumn("past", F.sum("s").over(recent)).withColumn("loss", F.col("s") / F.col("n"))
    by_past = F.struct(F.round("past", 8), F.col("alpha"))
    by_now = F.struct(F.round("loss", 10), F.col("alpha"))
    picked = scored.groupBy("day").agg(
        F.min_by(F.struct("alpha", "loss", "past"), by_past).alias("c"),
        F.min_by(F.struct("alpha", "loss"), by_now).alias("o"))
    return picked.filter(F.col("c.past").isNotNull()).select(
        "day", F.col("c.alpha").alias("alpha"), F.col("o.alpha").alias("alpha_oracle"),
        F.col("c.loss").alias("loss"), (F.col("c.loss") - F.col("o.loss")).alias("headroom"))


def select_on(days: DataFrame, losses: DataFrame, keys: list[str], by: str = "expert") -> DataFrame:
    """Expert with the lowest impression-weighted loss on the given days; ties go to the one listed first.

    ``days``: (keys..., day); ``losses``: (day, expert, ord, n, loss).
    """
    pooled = days.join(losses, "day").groupBy(*keys, by, "ord").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    pick = F.min_by(F.struct(by, "loss"), F.struct(F.round("loss", 10), F.col("ord"))).alias("_b")
    chosen = pooled.groupBy(*keys).agg(pick) if keys else pooled.agg(pick)
    return chosen.select(*keys, f"_b.{by}", "_b.loss")


def sample_psi(delta: float):
    """Bernstein width from row-level variance; the whole range M below two rows."""
    log = math.log(2.0 / delta)

    def psi(size, _k, sd, bound, _t):
        tight = sd * F.sqrt(2.0 * log / size) + 8.0 * bound * log / (3.0 * (size - 1))
        return F.when(size < 2, bound).otherwise(tight)
    return psi


def daily_psi(delta: float, m: int):
    """Empirical Bernstein width for day-level losses, confidence split over days and pairs."""
    def psi(_size, k, sd, bound, t):
        log = F.log(2.0 / (delta / (3.0 * m * m * t)))
        return sd * F.sqrt(2.0 * log / k) + 7.0 * bound * log / (3.0 * F.greatest(k - 1, F.lit(1)))
    return psi


def tournament(stats: DataFrame, order: list[str], psi, bound: Column | None, min_history: int = 3,
               fallback: str | None = None) -> DataFrame:
    """Single-elimination tournament over adaptively chosen windows, for every day at once.

    ``stats``: (day, b, mu, sq) with mu and sq arrays in ``order``. For each day
    t and window length k the width psi and the bias proxy come from running
    maxima over k, so a round costs O(days) per t and every round reuses the
    partitioning by t: one shuffle in total.
    """
    past = stats.select(F.col("day").alias("e"), "b", "mu", "sq")
    pairs = stats.select(F.col("day").alias("t")).join(past, F.col("e") < F.col("t"))
    whole = Window.partitionBy("t")
    back = Window.partitionBy("t").orderBy(F.col("e").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = pairs.withColumn("_days", F.count("*").over(whole)).filter(F.col("_days") >= min_history)
    df = df.withColumn("_c", F.lit(1)).withColumn("k", F.row_number().over(
        Window.partitionBy("t").orderBy(F.col("e").desc())))
    for r in range(2, len(order) + 1):
        mu_a, mu_b = F.element_at("mu", F.col("_c")), F.element_at("mu", r)
        sq_a, sq_b = F.element_at("sq", F.col("_c")), F.element_at("sq", r)
        df = df.withColumns({"_u": mu_a - mu_b, "_q": sq_a - 2.0 * mu_a * mu_b + sq_b})
        size, s1, s2 = (F.sum("b").over(back), F.sum(F.col("b") * F.col("_u")).over(back),
                        F.sum(F.col("b") * F.col("_q")).over(back))
        df = df.withColumns({"_size": size, "_s1": s1, "_s2": s2})
        mean = F.col("_s1") / F.col("_size")
        ss = F.col("_s2") - 2.0 * mean * F.col("_s1") + F.col("_size") * mean * mean
        sd = F.when(F.col("_size") > 1, F.sqrt(F.greatest(ss, F.lit(0.0)) / (F.col("_size") - 1))).otherwise(0.0)
        top = bound if bound is not None else F.greatest(
            F.max("_u").over(whole) - F.min("_u").over(whole), F.lit(1e-6))
        df = df.withColumns({"_m": mean, "_sd": sd, "_top": top})
        df = df.withColumn("_psi", psi(F.col("_size"), F.col("k"), F.col("_sd"), F.col("_top"), F.col("_days")))
        above = F.max(-F.col("_m") - F.col("_psi")).over(back)
        below = F.max(F.col("_m") - F.col("_psi")).over(back)
        bias = F.greatest(F.col("_m") + above, below - F.col("_m")) - F.col("_psi")
        df = df.withColumn("_score", F.round(F.greatest(bias, F.lit(0.0)) + F.col("_psi"), 12))
        best = F.min_by(F.col("_m"), F.struct("_score", "k")).over(whole)
        df = df.withColumn("_c", F.when(F.round(best, 12) <= 0, F.col("_c")).otherwise(F.lit(r)))
    names = F.array(*[F.lit(n) for n in order])
    chosen = df.groupBy(F.col("t").alias("day")).agg(F.element_at(names, F.max("_c")).alias("expert"))
    if fallback is None:
        return chosen
    return stats.select("day").join(chosen, "day", "left").withColumn(
        "expert", F.coalesce("expert", F.lit(fallback)))


def cycle_length(series: DataFrame, min_period: int, max_period: int, min_history: int | None = None,
                 min_acf: float = 0.3) -> DataFrame:
    """Dominant cycle of the strictly earlier losses, per day; null while nothing is established.

    ``series``: (day, loss). The autocorrelation divides by the full sum of squares.
    """
    need = max(2 * max_period if min_history is None else min_history, 2 * min_period)
    order = Window.orderBy("day")  # one row per calendar day
    s = series.select("day", "loss", F.row_number().over(order).alias("i"))
    past = s.select(F.col("i").alias("j"), F.col("loss").alias("x"))
    pre = s.join(past, F.col("j") < F.col("i")).select("day", "i", "j", "x")
    mean = pre.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy("day")))
    lags = literal_rows(series.sparkSession, [(p,) for p in range(min_period, max_period + 1)], "lag int")
    left = mean.crossJoin(F.broadcast(lags))
    right = mean.select(F.col("day").alias("d2"), F.col("j").alias("j2"), F.col("c").alias("c2"))
    prod = left.join(right, (F.col("d2") == F.col("day")) & (F.col("j2") == F.col("j") + F.col("lag")), "left")
    acf = prod.groupBy("day", "i", "lag").agg(
        F.try_divide(F.sum(F.col("c") * F.col("c2")), F.sum(F.col("c") * F.col("c"))).alias("acf"))
    usable = acf.filter((F.col("i") - 1 >= need) & F.col("acf").isNotNull() & (F.col("lag") <= F.col("i") - 2))
    best = usable.groupBy("day").agg(F.max_by(F.struct("lag", "acf"), F.struct(
        F.round("acf", 10), -F.col("lag"))).alias("_b"))
    return s.select("day").join(best, "day", "left").select(
        "day", F.when(F.col("_b.acf") >= min_acf, F.col("_b.lag")).alias("period"),
        F.col("_b.acf").alias("acf"))
