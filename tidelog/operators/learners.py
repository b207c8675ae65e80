"""Click models fitted on history windows.

Every rule is a weight for each day of the log, and all windows of all days are
fitted together (``logistic``), at any size. Impressions with equal features are
one tally row with a weight, so a fit reads counts, not the log.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import logistic as lo
from tidelog.operators.features import HASH_WIDTH
from tidelog.operators.history import ETA_BOUNDS

ALPHA = lo.ALPHA


def feature_tallies(log: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """(day, columns..., extra..., n, clicks) with the categories as strings."""
    cast = [F.col(c).cast("string").alias(c) for c in columns]
    return log.groupBy("day", *cast, *(extra or [])).agg(F.count("*").alias("n"), F.sum("click").alias("clicks"))


def window_weights(ex: lo.Examples, windows: list[tuple[int, int]], matured: bool = False) -> np.ndarray:
    """(days, 2, fits): 1 on days [lo, hi); ``matured`` leaves out the late labels of day hi - 1."""
    out = np.zeros((len(ex.days), 2, len(windows)))
    for f, (low, high) in enumerate(windows):
        out[(ex.days >= low) & (ex.days < high), :, f] = 1.0
        if matured:
            out[ex.days == high - 1, 1, f] = 0.0
    return out


def aged_weights(ex: lo.Examples, targets: list[int], rates: np.ndarray, upto: list[int]) -> np.ndarray:
    """(days, 2, fits): exp(-rate * age) on the days before ``upto``, aged from the target day."""
    out = np.zeros((len(ex.days), 2, len(targets)))
    for f, (day, rate, cut) in enumerate(zip(targets, rates, upto, strict=True)):
        past = ex.days < cut
        out[past, :, f] = np.exp(-rate * (day - ex.days[past]))[:, None]
    return out


def _both_classes(ex: lo.Examples, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training rows and clicks of each fit, and whether both classes are there."""
    used = (weights > 0).astype(float)
    n, k = (np.einsum("dlf,dl->f", used, x) for x in (ex.n, ex.clicks))
    return n, k, (k > 0) & (k < n)


def fit_bank(tallies: DataFrame, bounds: DataFrame, columns: list[str], alpha: float = ALPHA,
             matured: bool = False, prior_fallback: bool = False, width: int = HASH_WIDTH) -> DataFrame:
    """Predictions of every distinct (day, lo, hi) window: (day, lo, hi, columns..., early, n, clicks, p, n_train).

    ``matured`` drops the previous day's tail; ``prior_fallback`` predicts the
    window's own rate (0.5 if empty) where no fit is possible, instead of nothing.
    """
    windows = sorted((r["day"], r["lo"], r["hi"]) for r in bounds.select("day", "lo", "hi").distinct().collect())
    ex = lo.examples(tallies, columns, width)
    weights = window_weights(ex, [w[1:] for w in windows], matured)
    n, k, able = _both_classes(ex, weights)
    scored = lo.predictions(ex, lo.minimise(ex, weights, alpha), [w[0] for w in windows], able)
    prior = [float(b / a) if a else 0.5 for a, b in zip(n, k, strict=True)]
    table = lo.fit_table(tallies.sparkSession, [(f, *w, prior[f], int(n[f])) for f, w in enumerate(windows)],
                         "fit int, day int, lo int, hi int, prior double, n_train long")
    out = scored.join(F.broadcast(table), "fit")
    out = out.withColumn("p", F.coalesce("p", "prior")) if prior_fallback else out.where("p is not null")
    return out.select("day", "lo", "hi", *columns, "early", "n", "clicks", "p", "n_train")


def fit_rules(tallies: DataFrame, days: list[int], rules: dict[str, tuple[int | None, float | None]], columns: list[str],
              alpha: float = ALPHA, width: int = HASH_WIDTH) -> DataFrame:
    """(day, rule, columns..., early, n, clicks, p) for every day and rule {name: (window days, half-life)}.

    p is null for a rule that has no rows, or one class only, before a day.
    """
    ex = lo.examples(tallies, columns, width)
    fits = [(day, name) for day in days for name in rules]
    weights = np.zeros((len(ex.days), 2, len(fits)))
    for f, (day, name) in enumerate(fits):
        window, half_life = rules[name]
        past = (ex.days < day) & (ex.days >= (day - window if window else ex.days.min(initial=0)))
        weights[past, :, f] = (np.ones(past.sum()) if half_life is None else np.exp(-math.log(2.0) / half_life * (day - ex.days[past])))[:, None]
    scored = lo.predictions(ex, lo.minimise(ex, weights, alpha), [d for d, _ in fits], _both_classes(ex, weights)[2])
    table = lo.fit_table(tallies.sparkSession, [(f, *x) for f, x in enumerate(fits)], "fit int, day int, rule string")
    return scored.join(F.broadcast(table), "fit").drop("fit")


def golden_sections(f, lo_: np.ndarray, hi_: np.ndarray, evaluations: int) -> np.ndarray:
    """Minimisers of many one-dimensional functions; ``f`` takes a probe for each of them and evaluates all at once."""
    ratio = (5.0 ** 0.5 - 1) / 2
    low, high = lo_.astype(float).copy(), hi_.astype(float).copy()
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(evaluations - 2):
        left = fa <= fb
        high, low = np.where(left, b, high), np.where(left, low, a)
        probe = np.where(left, high - ratio * (high - low), low + ratio * (high - low))
        value = f(probe)
        a, b, fa, fb = np.where(left, probe, b), np.where(left, a, probe), np.where(left, value, fb), np.where(left, fa, value)
    return np.where(fa <= fb, a, b)


def fit_forgetting(tallies: DataFrame, days: list[int], columns: list[str], val_window: int = 3, evaluations: int = 12,
                   alpha: float = ALPHA, width: int = HASH_WIDTH) -> tuple[DataFrame, DataFrame]:
    """Learned forgetting rate with the fitted model for every day: (t, eta, half_life), and (t, columns..., early, n, clicks, p).

    One golden-section search for each day, all probes of a round fitted
    together: a weighted fit on the days before the last ``val_window`` days
    with rows, its loss on those. The final fit uses all history. A day with
    fewer than 2 * val_window days of history, or one class in them, has nulls.
    """
    spark = tallies.sparkSession
    ex = lo.examples(tallies, columns, width)
    past = {t: ex.days[ex.days < t] for t in days}
    cuts = {t: int(h[-val_window]) for t, h in past.items() if len(h) >= 2 * val_window}
    weights = aged_weights(ex, list(cuts), np.zeros(len(cuts)), list(cuts.values()))
    able = [t for t, ok in zip(cuts, _both_classes(ex, weights)[2], strict=True) if ok]
    upto = [cuts[t] for t in able]
    held = np.zeros((len(ex.days), 2, len(able)))
    for f, t in enumerate(able):
        held[(ex.days >= cuts[t]) & (ex.days < t), :, f] = 1.0
    warm: list[np.ndarray | None] = [None]

    def loss(rates: np.ndarray) -> np.ndarray:
        warm[0] = lo.minimise(ex, aged_weights(ex, able, rates, upto), alpha, warm[0], tol=1e-5)
        return lo.losses(ex, held, warm[0])

    low, high = (np.full(len(able), x) for x in ETA_BOUNDS)
    eta = golden_sections(loss, low, high, evaluations) if able else np.zeros(0)
    params = lo.minimise(ex, aged_weights(ex, able, eta, able), alpha, warm[0])
    found = {t: (float(e), math.log(2.0) / float(e) if e > 1e-9 else None) for t, e in zip(able, eta, strict=True)}
    table = lo.fit_table(spark, [(t, *found.get(t, (None, None))) for t in days], "t int, eta double, half_life double")
    names = lo.fit_table(spark, list(enumerate(able)), "fit int, t int")
    return table, lo.predictions(ex, params, able).join(F.broadcast(names), "fit").drop("fit")
