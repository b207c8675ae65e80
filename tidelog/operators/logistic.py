"""Many L2 logistic regressions at once, on hashed features, by one Spark job per step.

A fit is a weight for every (day, early or late) of the log; windows, decays and
maturity rules are such weights. All fits read the same tally rows. A step sends
the parameters of a group of fits to the tasks, which add up loss and gradient
of every fit over their rows; a second stage adds the tasks' sums, so the driver
receives one number a parameter. The driver runs preconditioned L-BFGS for all
fits side by side. Tables of any size go the same way.

The objective is the weighted mean log loss plus ``alpha`` / 2 * ||w||^2 without
the intercept, with the penalty of an unweighted fit: alpha counts per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.features import HASH_WIDTH, hash_codes
from tidelog.session import settle

ALPHA = 1e-4
#: Parameters of one group of fits: what a step sends to each task and gets back.
GROUP_VALUES = 4_000_000
CHUNK = 4096
PIECE = 512
MEMORY = 8


@dataclass(frozen=True)
class Examples:
    """Settled tally rows (day, early, idx, n, clicks), their columns, days, used feature positions and per-day counts."""

    rows: DataFrame
    columns: list[str]
    days: np.ndarray
    active: np.ndarray
    n: np.ndarray
    clicks: np.ndarray

    @property
    def size(self) -> int:
        return len(self.active) + 1


def examples(tallies: DataFrame, columns: list[str], width: int = HASH_WIDTH) -> Examples:
    """Tallies (day, columns..., [early], n, clicks) with hashed positions, laid out by day.

    At most ``width`` positions, and two counts for each day, reach the driver.
    """
    if "early" not in tallies.columns:
        tallies = tallies.withColumn("early", F.lit(True))
    slices = int(tallies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(tallies.withColumn("idx", hash_codes(columns, width)).repartitionByRange(slices, "day", *columns))
    active = np.array(sorted(r[0] for r in rows.select(F.explode("idx")).distinct().collect()), dtype=np.int64)
    counts = rows.groupBy("day", "early").agg(F.sum("n").alias("n"), F.sum("clicks").alias("k")).collect()
    days = np.array(sorted({r["day"] for r in counts}), dtype=np.int64)
    n, k = np.zeros((len(days), 2)), np.zeros((len(days), 2))
    for r in counts:
        at = np.searchsorted(days, r["day"]), 0 if r["early"] else 1
        n[at], k[at] = r["n"], r["k"]
    return Examples(rows, columns, days, active, n, k)


def _margins(params: np.ndarray, at: np.ndarray, fits: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(params[-1, fits], (len(at), len(fits))).copy()
    for c in range(at.shape[1]):
        out += params[at[:, c]][:, fits]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _columns(batch: pa.RecordBatch, days: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, ...]:
    """Day position, 0 for early and 1 for late, feature positions, n and clicks of a batch."""
    day = np.searchsorted(days, batch.column("day").to_numpy().astype(np.int64))
    late = 1 - batch.column("early").to_numpy(zero_copy_only=False).astype(np.int64)
    idx = np.searchsorted(active, batch.column("idx").flatten().to_numpy().astype(np.int64)).reshape(batch.num_rows, -1)
    return day, late, idx, batch.column("n").to_numpy().astype(float), batch.column("clicks").to_numpy().astype(float)


def _sums(ex: Examples, weights: np.ndarray, params: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted loss of every fit; with ``order`` 1 the gradient too; with 2 also the diagonal curvature.

    ``weights``: (days, 2, fits); ``params``: (positions + 1, fits).
    """
    spark = ex.rows.sparkSession
    sent = spark.sparkContext.broadcast((ex.days, ex.active, weights, params))
    size, fits = params.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, active, weight, par = sent.value
        total = np.zeros((1 + order * size, fits))
        for batch in batches:
            every = _columns(batch, days, active)
            for lo in range(0, batch.num_rows, CHUNK):
                day, late, at, n, k = (x[lo:lo + CHUNK] for x in every)
                rows = weight[day, late]
                used = np.flatnonzero(rows.any(axis=0))
                if not len(used):
                    continue
                rows = rows[:, used]
                margin = _margins(par, at, used)
                total[0, used] += (rows * (n[:, None] * np.logaddexp(0.0, margin) - k[:, None] * margin)).sum(axis=0)
                if not order:
                    continue
                p = sigmoid(margin)
                parts = [rows * (n[:, None] * p - k[:, None]), rows * n[:, None] * p * (1 - p)][:order]
                for i, part in enumerate(parts):
                    base = 1 + i * size
                    total[base + size - 1, used] += part.sum(axis=0)
                    for c in range(at.shape[1]):
                        by = np.argsort(at[:, c], kind="stable")
                        first = np.flatnonzero(np.concatenate([[True], np.diff(at[by, c]) > 0]))
                        total[(base + at[by[first], c])[:, None], used[None, :]] += np.add.reduceat(part[by], first, axis=0)
        held = [q for q in range(0, len(total), PIECE) if total[q:q + PIECE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([total[q:q + PIECE].tobytes() for q in held], pa.binary())],
                                         ["piece", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for q, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw)
                sums[q] = sums[q] + part if q in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         ["piece", "sums"])

    schema = "piece long, sums binary"
    pieces = -(-(1 + order * size) // PIECE)
    slices = min(pieces, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((1 + order * size, fits))
    for r in ex.rows.mapInArrow(partial, schema).repartition(slices, "piece").mapInArrow(added, schema).collect():
        own = np.frombuffer(r["sums"]).reshape(-1, fits)
        out[r["piece"]:r["piece"] + len(own)] = own
    sent.unpersist()
    return out[0], out[1:1 + size], out[1 + size:]


def _directions(grad: np.ndarray, scale: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop L-BFGS recursion, column by column; pairs without positive curvature count for nothing."""
    q, held = grad.copy(), []
    for s, y in reversed(steps):
        sy = (s * y).sum(axis=0)
        rho = np.where(sy > 1e-300, 1.0 / np.where(sy > 1e-300, sy, 1.0), 0.0)
        a = rho * (s * q).sum(axis=0)
        q -= a * y
        held.append((s, y, rho, a))
    r = q / scale
    for s, y, rho, a in reversed(held):
        r += s * (a - rho * (y * r).sum(axis=0))
    return -r


def minimise(ex: Examples, weights: np.ndarray, alpha: float = ALPHA, start: np.ndarray | None = None, tol: float = 1e-6,
             most: int = 150) -> np.ndarray:
    """Parameters (positions + 1, fits) of all fits; a fit without both classes keeps its start.

    A step is one job. A fit whose trial does not lower its loss enough halves
    its own step; finished fits are left out of the jobs.
    """
    fits = weights.shape[2]
    params = np.zeros((ex.size, fits)) if start is None else start.copy()
    seen, hit = (np.einsum("dlf,dl->f", weights, x) for x in (ex.n, ex.clicks))
    rows = np.einsum("dlf,dl->f", (weights > 0).astype(float), ex.n)
    able = (hit > 0) & (hit < seen)
    if start is None:
        params[-1, able] = np.log(hit[able] / (seen - hit)[able])
    group = max(1, GROUP_VALUES // ex.size)
    for lo in range(0, fits, group):
        cols = np.flatnonzero(able[lo:lo + group]) + lo
        if len(cols):
            params[:, cols] = _minimise_group(ex, weights[:, :, cols], params[:, cols], seen[cols], alpha * rows[cols] / seen[cols], tol, most)
    return params


def _minimise_group(ex: Examples, weights: np.ndarray, x: np.ndarray, seen: np.ndarray, ridge: np.ndarray, tol: float, most: int) -> np.ndarray:
    penalty = np.ones((ex.size, 1)) * ridge
    penalty[-1] = 0.0

    def full(loss, grad, at, cols):
        return (loss / seen[cols] + 0.5 * (penalty[:, cols] * at * at).sum(axis=0), grad / seen[cols] + penalty[:, cols] * at)

    every = np.arange(x.shape[1])
    loss, grad, curve = _sums(ex, weights, x, 2)
    value, grad = full(loss, grad, x, every)
    scale = curve / seen + penalty + 1e-8
    history: list[tuple[np.ndarray, np.ndarray]] = []
    open_ = np.abs(grad).max(axis=0) > tol
    way, size = _directions(grad, scale, history), np.ones(x.shape[1])
    for _ in range(most):
        cols = np.flatnonzero(open_)
        if not len(cols):
            break
        trial = x[:, cols] + size[cols] * way[:, cols]
        loss, slope, _ = _sums(ex, weights[:, :, cols], trial, 1)
        new, slope = full(loss, slope, trial, cols)
        fall = (grad[:, cols] * way[:, cols]).sum(axis=0)
        good = new <= value[cols] + 1e-4 * size[cols] * fall + 1e-14
        s, y = np.zeros_like(x), np.zeros_like(x)
        took = cols[good]
        s[:, took], y[:, took] = trial[:, good] - x[:, took], slope[:, good] - grad[:, took]
        x[:, took], grad[:, took], value[took] = trial[:, good], slope[:, good], new[good]
        size[cols] = np.where(good, 1.0, size[cols] / 2)
        history = [*history, (s, y)][-MEMORY:]
        way[:, took] = _directions(grad[:, took], scale[:, took], [(a[:, took], b[:, took]) for a, b in history])
        open_[cols] = (np.abs(grad[:, cols]).max(axis=0) > tol) & (size[cols] > 1e-10)
    return x


def losses(ex: Examples, weights: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Mean weighted log loss of every fit on rows of its own choice; NaN without rows."""
    seen = np.einsum("dlf,dl->f", weights, ex.n)
    total = np.zeros(weights.shape[2])
    group = max(1, GROUP_VALUES // ex.size)
    for lo in range(0, len(total), group):
        total[lo:lo + group] = _sums(ex, weights[:, :, lo:lo + group], params[:, lo:lo + group], 0)[0]
    return np.where(seen > 0, total / np.where(seen > 0, seen, 1.0), np.nan)


def predictions(ex: Examples, params: np.ndarray, test_days: list[int], keep: np.ndarray | None = None) -> DataFrame:
    """(fit, columns..., early, n, clicks, p): every fit on the rows of its test day; p is null where ``keep`` is false."""
    spark = ex.rows.sparkSession
    by_day: dict[int, list[int]] = {}
    for f, day in enumerate(test_days):
        by_day.setdefault(int(day), []).append(f)
    known = np.ones(len(test_days), dtype=bool) if keep is None else keep
    sent = spark.sparkContext.broadcast((ex.days, ex.active, by_day, params, known))
    kept = [*ex.columns, "early"]
    names = ["fit", *kept, "n", "clicks", "p"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, active, fits, par, fitted = sent.value
        for batch in batches:
            _, _, at, _, _ = _columns(batch, days, active)
            day = batch.column("day").to_numpy()
            for d in np.unique(day).tolist():
                mine = np.flatnonzero(day == d)
                rows = batch.take(pa.array(mine))
                for f in fits.get(d, []):
                    p = sigmoid(_margins(par, at[mine], np.array([f]))[:, 0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), f, dtype=np.int32)), *[rows.column(c) for c in kept],
                         rows.column("n").cast(pa.int64()), rows.column("clicks").cast(pa.int64()),
                         pa.array(p) if fitted[f] else pa.nulls(len(mine), pa.float64())], names)

    schema = "fit int, " + ", ".join(f"{c} string" for c in ex.columns) + ", early boolean, n long, clicks long, p double"
    return ex.rows.mapInArrow(score, schema)


def fit_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """One row for each fit: at most days times rules."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names) if rows else [], schema)
