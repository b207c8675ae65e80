"""History rules as range frames, and experts whose predictions follow from them.

The rate expert needs only (n, clicks) per (cell, day), so a window over the
history is a range frame over a table with one row per cell and day. The log
itself is read once, by a partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.session import literal_rows, settle

# Nominal horizons in days, None = all earlier days.
HORIZONS = {"roll1": 1, "roll3": 3, "roll7": 7, "roll14": 14, "expanding": None}
HALF_LIVES = {"decay1": 1, "decay3": 3, "decay7": 7}
WINDOW_ORDER = list(HORIZONS)
SHORT, LONG = "roll3", "expanding"
NOMINAL_DAYS = {"roll1": 1, "roll3": 3, "roll7": 7, "roll14": 14, "expanding": 60}

PRIOR_RATE = 0.4
PRIOR_STRENGTH = 2.0


def expert_registry(spark: SparkSession) -> DataFrame:
    """One row per history rule: name, window length (null = unbounded), half-life (null = unweighted)."""
    rows = [(n, i, h, None) for i, (n, h) in enumerate(HORIZONS.items())]
    rows += [(n, len(HORIZONS) + i, None, float(h)) for i, (n, h) in enumerate(HALF_LIVES.items())]
    return literal_rows(spark, rows, "expert string, ord int, window_days int, half_life double")


def history_bounds(days: DataFrame, registry: DataFrame) -> DataFrame:
    """[lo, hi) of every (day, rule); rules with equal bounds train on the same rows."""
    windows = registry.filter(F.col("half_life").isNull())
    return days.crossJoin(F.broadcast(windows)).select(
        "day", "expert", "ord",
        F.when(F.col("window_days").isNull(), F.lit(0))
        .otherwise(F.greatest(F.lit(0), F.col("day") - F.col("window_days"))).cast("int").alias("lo"),
        F.col("day").alias("hi"))


def effective_experts(bounds: DataFrame) -> DataFrame:
    """Alias table: experts of a day with the same bounds share one effective id, in registry order."""
    per_window = Window.partitionBy("day", "lo", "hi")
    first = bounds.withColumn("_first", F.min("ord").over(per_window))
    return first.withColumn("effective_id", (F.dense_rank().over(
        Window.partitionBy("day").orderBy("_first")) - 1).cast("int")).drop("_first")


def training_volume(day_counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows each rule trains on, from the per-day counts (one row per day)."""
    hist = day_counts.select(F.col("day").alias("e"), "n")
    days = F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo"), F.col("hi") - 1))
    joined = bounds.withColumn("e", F.explode_outer(days)).join(hist, "e", "left")
    return joined.groupBy("day", "expert", "ord").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_train"))


def cell_counts(imp: DataFrame, keys: list[str], delay_sec: int = ta.LABEL_DELAY_SEC) -> DataFrame:
    """Sufficient statistics of the log: counts per (cell, day), and the unmatured tail of the day."""
    tail = ~ta.matured_by_midnight(F.col("sec"), delay_sec)
    return imp.groupBy(*keys, "day").agg(
        F.count("*").alias("n"), F.sum("click").alias("clicks"),
        F.sum(tail.cast("long")).alias("n_tail"),
        F.sum(F.when(tail, F.col("click")).otherwise(0)).alias("k_tail"))


def roll_up(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser cells from finer ones, so that both come from one pass over the log."""
    return counted.groupBy(*keys, "day").agg(*[F.sum(c).alias(c) for c in ("n", "clicks", "n_tail", "k_tail")])


def smoothed(clicks: Column, n: Column, prior: float = PRIOR_RATE, strength: float = PRIOR_STRENGTH) -> Column:
    return (clicks + prior * strength) / (n + strength)


def _frame(keys: list[str], window_days: int | None):
    w = Window.partitionBy(*keys).orderBy("day")
    return w.rangeBetween(Window.unboundedPreceding if window_days is None else -window_days, -1)


def rate_bank(cells: DataFrame, keys: list[str], horizons: dict[str, int | None] = HORIZONS,
              matured: bool = False, with_train: bool = False) -> DataFrame:
    """Wide bank: one column per horizon, each from strictly earlier days.

    ``matured=True`` also leaves out labels of the previous day that had not
    arrived by midnight (delay of at most one day).
    """
    def zero(c):
        return F.coalesce(c, F.lit(0))

    yesterday = _frame(keys, 1)
    out = list(cells.columns)
    cols = []
    for name, h in horizons.items():
        frame = _frame(keys, h)
        n, k = zero(F.sum("n").over(frame)), zero(F.sum("clicks").over(frame))
        if matured:
            n = n - zero(F.sum("n_tail").over(yesterday))
            k = k - zero(F.sum("k_tail").over(yesterday))
        cols.append(smoothed(k, n).alias(name))
        if with_train:
            cols.append(n.alias(f"n_{name}"))
    return cells.select(*out, *cols)


def decayed_bank(cells: DataFrame, keys: list[str], half_lives: dict[str, float] = HALF_LIVES) -> DataFrame:
    """Rate experts with weight 2^(-age/half_life); an ordered fold per cell keeps it linear in days."""
    steps = F.sort_array(F.collect_list(F.struct("day", "n", "clicks")))
    grouped = cells.groupBy(*keys).agg(steps.alias("_h"))
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("n"), F.lit(0.0).alias("k"),
                    F.expr("cast(array() as array<struct<day:int,n:double,k:double>>)").alias("path"))

    def stepper(hl: float):
        def step(acc, x):
            fade = F.when(acc["at"].isNull(), F.lit(0.0)).otherwise(sc.age_weight(x["day"] - acc["at"], hl))
            n, k = acc["n"] * fade, acc["k"] * fade
            seen = F.struct(x["day"].alias("day"), n.alias("n"), k.alias("k"))
            return F.struct(x["day"].alias("at"), (n + x["n"]).alias("n"), (k + x["clicks"]).alias("k"),
                            F.concat(acc["path"], F.array(seen)).alias("path"))
        return step

    exprs = [F.aggregate("_h", zero, stepper(hl), lambda a: a["path"]).alias(name)
             for name, hl in half_lives.items()]
    paths = grouped.select(*keys, F.inline(F.arrays_zip(*exprs)))
    first = next(iter(half_lives))
    return paths.select(*keys, F.col(f"{first}.day").alias("day"),
                        *[smoothed(F.col(f"{n}.k"), F.col(f"{n}.n")).alias(n) for n in half_lives])


def long_bank(wide: DataFrame, experts: list[str], keep: list[str]) -> DataFrame:
    """Wide to long without a shuffle: (keep..., expert, ord, p)."""
    rows = [F.struct(F.lit(e).alias("expert"), F.lit(i).alias("ord"), F.col(e).alias("p"))
            for i, e in enumerate(experts)]
    return wide.select(*keep, F.inline(F.array(*rows)))


def uniform_mix(wide: DataFrame, experts: list[str], name: str = "uniform5") -> DataFrame:
    return wide.withColumn(name, sum((F.col(e) for e in experts), F.lit(0.0)) / len(experts))


def forgetting_rates(cells: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Rate per (target, cell) with weight exp(-eta * (t - day)) on days in [.., upto).

    ``targets`` holds one row per fit: (t, upto, eta, ...); it is small and joins
    by range to the daily cells, never to the log.
    """
    hist = cells.select(*keys, F.col("day").alias("e"), "n", "clicks")
    joined = hist.join(F.broadcast(targets), F.col("e") < F.col("upto"))
    w = F.exp(-F.col("eta") * (F.col("t") - F.col("e")))
    return joined.groupBy(*targets.columns, *keys).agg(
        smoothed(F.sum(w * F.col("clicks")), F.sum(w * F.col("n"))).alias("rate"))


def forgetting_losses(cells: DataFrame, keys: list[str], targets: DataFrame, val_window: int = 3) -> DataFrame:
    """Held-out loss of every (t, eta): fit before the last ``val_window`` history days, score on them."""
    rates = forgetting_rates(cells, keys, targets)
    held = cells.select(*keys, F.col("day").alias("v"), "n", "clicks")
    scored = (held.join(F.broadcast(targets), (F.col("v") >= F.col("upto")) & (F.col("v") < F.col("t")))
              .join(rates, [*targets.columns, *keys], "left"))
    p = F.coalesce(F.col("rate"), F.lit(PRIOR_RATE))
    return scored.groupBy(*targets.columns).agg(
        (F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), p)) / F.sum("n")).alias("loss"))


# Fixed value: search interval of the forgetting rate.
ETA_BOUNDS = (0.0, 3.0)


def learn_forgetting(cells: DataFrame, keys: list[str], days: list[int], val_window: int = 3,
                     evaluations: int = 12) -> DataFrame:
    """Golden-section search of the forgetting rate, for all prediction days at once.

    Each evaluation is one job over the daily cells for every day's current
    probe; the driver keeps one bracket per day.
    """
    spark = cells.sparkSession
    cells = settle(cells)
    ratio = (math.sqrt(5.0) - 1) / 2
    state = {}
    for t in days:
        lo, hi = ETA_BOUNDS
        state[t] = {"lo": lo, "hi": hi, "a": hi - ratio * (hi - lo), "b": lo + ratio * (hi - lo),
                    "fa": None, "fb": None}

    def evaluate(probes: dict[int, float]) -> dict[int, float]:
        rows = [(t, t - val_window, float(e)) for t, e in probes.items()]
        targets = literal_rows(spark, rows, "t int, upto int, eta double")
        return {r["t"]: r["loss"] for r in forgetting_losses(cells, keys, targets, val_window).collect()}

    fa = evaluate({t: s["a"] for t, s in state.items()})
    fb = evaluate({t: s["b"] for t, s in state.items()})
    for t, s in state.items():
        s["fa"], s["fb"] = fa[t], fb[t]
    for _ in range(evaluations - 2):
        probes, side = {}, {}
        for t, s in state.items():
            if s["fa"] <= s["fb"]:
                s["hi"], s["b"], s["fb"] = s["b"], s["a"], s["fa"]
                s["a"] = s["hi"] - ratio * (s["hi"] - s["lo"])
                probes[t], side[t] = s["a"], "fa"
            else:
                s["lo"], s["a"], s["fa"] = s["a"], s["b"], s["fb"]
                s["b"] = s["lo"] + ratio * (s["hi"] - s["lo"])
                probes[t], side[t] = s["b"], "fb"
        values = evaluate(probes)
        for t, s in state.items():
            s[side[t]] = values[t]
    rows = []
    for t, s in state.items():
        eta = s["a"] if s["fa"] <= s["fb"] else s["b"]
        rows.append((t, t, eta, math.log(2) / eta if eta > 1e-9 else None))
    return literal_rows(spark, rows, "t int, upto int, eta double, half_life double")
