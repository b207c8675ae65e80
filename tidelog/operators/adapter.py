"""Rolling linear adapter: offset logistic regressions for every day and setting, solved together.

A fit adds w . phi to a frozen logit; it is trained on all days before its own
day, so the fit that an inner day is judged by is also the one that is deployed
on it. Days times settings are all there is to fit. The curvature of a logistic
loss is at most a quarter of the feature moments: those are summed once for each
day, added up over the days before, and factorised on the driver. Every step
then needs one job, which sums the gradients of all fits over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import online as on
from tidelog.session import settle


@dataclass(frozen=True)
class Setting:
    """Size of the random interactions, and the penalty reg / 2 * ||w||^2 beside the mean loss."""

    cross: int
    reg: float


def _added(rows: DataFrame, sums: Callable[[pd.DataFrame], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums of arrays by key: each task adds up its rows, a second stage the tasks' parts, one array a key is collected."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for key, value in sums(pdf).items():
                    total[key] = total.get(key, 0.0) + value
        yield pd.DataFrame({"key": list(total), "sums": [v.tobytes() for v in total.values()]})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for key, raw in zip(pdf["key"], pdf["sums"], strict=True):
                total[key] = total.get(key, 0.0) + np.frombuffer(raw)
        yield pd.DataFrame({"key": list(total), "sums": [v.tobytes() for v in total.values()]})

    schema = "key long, sums binary"
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.mapInPandas(partial, schema).repartition(slices, "key").mapInPandas(joined, schema)
    return {r["key"]: np.frombuffer(r["sums"]) for r in parts.collect()}


@dataclass(frozen=True)
class Rolling:
    """All fits: the days, rows a day, and for each cross size the weights (features, days, penalties)."""

    days: list[int]
    n: np.ndarray
    settings: list[Setting]
    weights: dict[int, np.ndarray]
    regs: list[float]


def fit_all(rows: DataFrame, settings: list[Setting], tol: float = 1e-9, most: int = 100) -> tuple[DataFrame, Rolling]:
    """(rows settled, fits): the adapter of every day and setting, from rows (day, click, z, a, s) of earlier days."""
    rows = settle(rows.repartitionByRange("day", "row_id"))
    counts = {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.count("*").alias("n")).collect()}
    days, regs = sorted(counts), sorted({s.reg for s in settings})
    place = {d: i for i, d in enumerate(days)}
    n = np.array([counts[d] for d in days], dtype=float)
    sizes = sorted({s.cross for s in settings})

    def moments(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        out = {}
        for c, cross in enumerate(sizes):
            phi = on._phi(pdf, cross)
            for d in pdf["day"].unique():
                own = phi[(pdf["day"] == d).to_numpy()]
                out[place[int(d)] * len(sizes) + c] = (own.T @ own).ravel()
        return out

    found = _added(rows, moments)
    before = np.concatenate([[0.0], np.cumsum(n)[:-1]])  # training rows of each day's fits
    weights, curves = {}, {}
    for c, cross in enumerate(sizes):
        width = int(round(np.sqrt(len(found[c])))) if days else 0
        past, curve = np.zeros((width, width)), np.zeros((len(days), len(regs), width, width))
        for i in range(len(days)):
            for r, reg in enumerate(regs):
                curve[i, r] = 0.25 * past / max(before[i], 1.0) + reg * np.eye(width)
            past = past + found[i * len(sizes) + c].reshape(width, width)
        weights[c], curves[c] = np.zeros((width, len(days), len(regs))), curve
    for _ in range(most if len(days) > 1 else 0):
        sent = {c: w.copy() for c, w in weights.items()}

        def gradients(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
            out, at = {}, np.array([place[int(d)] for d in pdf["day"]])
            z, y = pdf["z"].to_numpy(), pdf["click"].to_numpy()
            for c, cross in enumerate(sizes):
                phi = on._phi(pdf, cross)
                total = np.zeros_like(sent[c])
                for i in np.unique(at):
                    mine, later = at == i, slice(i + 1, None)  # a row trains the fits of the days after its own
                    flat = sent[c][:, later].reshape(phi.shape[1], -1)
                    resid = on._sigmoid(z[mine][:, None] + phi[mine] @ flat) - y[mine][:, None]
                    total[:, later] += (phi[mine].T @ resid).reshape(phi.shape[1], -1, len(regs))
                out[c] = total.ravel()
            return out

        sums, worst = _added(rows, gradients), 0.0
        for c in weights:
            grad = sums[c].reshape(weights[c].shape) / np.maximum(before, 1.0)[None, :, None] + weights[c] * np.array(regs)
            worst = max(worst, float(np.abs(grad[:, 1:]).max()))
            for i in range(1, len(days)):
                for r in range(len(regs)):
                    weights[c][:, i, r] -= np.linalg.solve(curves[c][i, r], grad[:, i, r])
        if worst < tol:
            break
    return rows, Rolling(days, n, settings, {sizes[c]: w for c, w in weights.items()}, regs)


def day_losses(rows: DataFrame, fits: Rolling) -> dict[int, np.ndarray]:
    """Per day: summed log losses of every setting's fit of that day, of the same without history, and of the frozen logit."""
    place = {d: i for i, d in enumerate(fits.days)}

    def losses(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        out = {}
        for d, part in pdf.groupby("day"):
            i, y, z = place[int(d)], part["click"].to_numpy(), part["z"].to_numpy()
            blank = part.assign(s=[np.zeros(len(s)) for s in part["s"]])

            def loss(margin: np.ndarray) -> float:
                p = np.clip(on._sigmoid(margin), 1e-6, 1 - 1e-6)
                return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

            sums = []
            for table in (part, blank):
                by_cross = {cross: on._phi(table, cross) for cross in fits.weights}
                sums += [loss(z + by_cross[s.cross] @ fits.weights[s.cross][:, i, fits.regs.index(s.reg)]) for s in fits.settings]
            out[i] = np.array([*sums, loss(z)])
        return out

    return _added(rows, losses)


def choose(mean: np.ndarray, settings: list[Setting], day: int, inner: int = 3) -> tuple[int, int, float] | None:
    """(setting, inner days, score) for the fits of day number ``day``: the simplest within one standard error of the best.

    ``mean``: (days, settings) losses. Inner days are the latest earlier ones that have a day before them.
    """
    folds = mean[max(1, day - inner):day]
    if not len(folds):
        return None
    score = folds.mean(axis=0)
    best = int(score.argmin())
    slack = folds[:, best].std(ddof=1) / np.sqrt(len(folds)) if len(folds) > 1 else 0.0
    within = [i for i in range(len(settings)) if score[i] <= score[best] + slack]
    pick = min(within, key=lambda i: (settings[i].cross, -settings[i].reg))
    return pick, len(folds), float(score[pick])


ROLLED = ("day int, n long, n_inner int, cross int, reg double, inner_score double, loss double, loss_no_history double, "
          "loss_frozen double")


def rolling_adapter(rows: DataFrame, settings: list[Setting], inner: int = 3) -> DataFrame:
    """A row for each day: its setting by nested selection, and the day's losses; nulls where no inner day exists."""
    spark = rows.sparkSession
    rows, fits = fit_all(rows, settings)
    sums = day_losses(rows, fits)
    k = len(settings)
    mean = np.array([sums[i] / fits.n[i] for i in range(len(fits.days))]).reshape(len(fits.days), 2 * k + 1)
    out = []
    for i, day in enumerate(fits.days):
        found = choose(mean[:, :k], settings, i, inner)
        if found is None:
            out.append((day, int(fits.n[i]), 0, None, None, None, None, None, float(mean[i, -1])))
        else:
            pick, folds, score = found
            out.append((day, int(fits.n[i]), folds, settings[pick].cross, settings[pick].reg, score, float(mean[i, pick]),
                        float(mean[i, k + pick]), float(mean[i, -1])))
    return spark.createDataFrame(out, ROLLED)  # one row for each day
