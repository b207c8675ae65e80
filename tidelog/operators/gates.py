"""Gates fitted online: per-row mixing weights trained day by day on matured labels.

A day's update is a few gradient jobs. Each job reads the day's rows once and
returns, per task, the partial sums of *all* configurations; the driver adds
them up and takes an Adam step on a few hundred numbers. Rows that share the
same features can come in as one tally row (n, clicks).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import settle

CLAMP = 1e-7


@dataclass(frozen=True)
class GateSpec:
    """``kind``: "pair" blends experts (short, long) with one logit, "multi" is a softmax over all experts.

    ``columns`` picks the entries of x the gate sees; ``experts`` the entries of p.
    """
    name: str
    kind: str = "multi"
    columns: tuple[int, ...] = ()
    experts: tuple[int, ...] = ()
    lr: float = 0.05
    l2: float = 1e-3
    entropy: float = 1e-3
    smooth: float = 1e-3
    epochs: int = 3


@dataclass(frozen=True)
class PersistSpec(GateSpec):
    """Softmax gate whose deployed weights lean on a persistent state: (1 - beta) q + beta m."""
    smooth: float = 0.0
    rho: float = 0.3
    init_bias: float = -1.0
    adaptive: bool = True
    fixed_beta: float = 0.0
    uniform_q: bool = False
    state: tuple[int, ...] | None = None
    per_example: bool = False
    beta_var: float = 0.0
    per_group: bool = False
    matured: bool = False


@dataclass
class Adam:
    size: int
    lr: float
    step: int = 0
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)

    def __post_init__(self):
        self.m, self.v = np.zeros(self.size), np.zeros(self.size)

    def move(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        fast = self.m / (1 - 0.9 ** self.step)
        scale = np.sqrt(self.v / (1 - 0.999 ** self.step)) + 1e-8
        return theta - self.lr * fast / scale


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pull(p, n, k):
    """Derivative of the summed log loss by the prediction; zero where the clamp is active."""
    c = np.clip(p, CLAMP, 1 - CLAMP)
    loss = -(k * np.log(c) + (n - k) * np.log(1 - c))
    return c, np.where(c == p, -k / c + (n - k) / (1 - c), 0.0), loss


def pair_sums(theta: np.ndarray, x, p, n, k, spec: GateSpec) -> dict[str, np.ndarray]:
    x1 = _with_one(x)
    alpha = _sigmoid(x1 @ theta)
    mixed = (1 - alpha) * p[:, 1] + alpha * p[:, 0]
    _, d, loss = _pull(mixed, n, k)
    slope = alpha * (1 - alpha)
    safe = np.clip(alpha, CLAMP, 1 - CLAMP)
    dz = (d * (p[:, 0] - p[:, 1]) + spec.entropy * n * np.log(safe / (1 - safe))) * slope
    return {"n": n.sum(), "loss": loss.sum(), "grad": x1.T @ dz, "mean": (n * alpha).sum(),
            "square": (n * alpha * alpha).sum(), "smooth": x1.T @ (n * slope)}


def multi_sums(theta: np.ndarray, x, p, n, k, spec: GateSpec) -> dict[str, np.ndarray]:
    x1, kk = _with_one(x), p.shape[1]
    q = _softmax(x1 @ theta.reshape(-1, kk))
    _, d, loss = _pull((p * q).sum(axis=1), n, k)
    g = d[:, None] * p + spec.entropy * n[:, None] * (np.log(np.clip(q, CLAMP, 1)) + 1)
    dz = q * (g - (q * g).sum(axis=1, keepdims=True))
    out = {"n": n.sum(), "loss": loss.sum(), "grad": (x1.T @ dz).ravel(), "mean": (n[:, None] * q).sum(axis=0)}
    if spec.smooth:
        eye = np.eye(kk)
        out["smooth"] = np.stack([(x1.T @ (n[:, None] * q[:, [h]] * (eye[h] - q))).ravel() for h in range(kk)])
    return out


def _beta(spec: PersistSpec, logit: float, xi: np.ndarray, x1: np.ndarray) -> np.ndarray:
    if not spec.adaptive:
        return np.full(len(x1), spec.fixed_beta)
    return _sigmoid(logit + (x1 @ xi if spec.per_example else 0.0) + np.zeros(len(x1)))


def persist_weights(spec: PersistSpec, par: dict, x, k_experts: int, group):
    """(q, beta, m per row, pi) for a batch."""
    x1 = _with_one(x)
    q = np.full((len(x), k_experts), 1.0 / k_experts) if spec.uniform_q else _softmax(x1 @ par["w"].reshape(-1, k_experts))
    beta = _beta(spec, par["logit"], par["xi"], x1)
    m = par["m"][group] if spec.per_group else np.broadcast_to(par["m"], q.shape)
    return x1, q, beta, m, (1 - beta)[:, None] * q + beta[:, None] * m


def persist_sums(par: dict, x, p, n, k, group, spec: PersistSpec) -> dict[str, np.ndarray]:
    kk = p.shape[1]
    x1, q, beta, m, pi = persist_weights(spec, par, x, kk, group)
    _, d, loss = _pull((p * pi).sum(axis=1), n, k)
    g = (1 - beta)[:, None] * d[:, None] * p + spec.entropy * n[:, None] * (np.log(np.clip(q, CLAMP, 1)) + 1)
    dz = q * (g - (q * g).sum(axis=1, keepdims=True))
    slope = beta * (1 - beta)
    db = d * (p * (m - q)).sum(axis=1) * slope
    sides = np.stack([group == 0, group == 1]).astype(float) * n
    return {"n": n.sum(), "loss": loss.sum(), "grad": (x1.T @ dz).ravel(), "logit": db.sum(), "xi": x1.T @ db,
            "v1": (n * slope * beta).sum(), "v0": (n * slope).sum(), "x1v": x1.T @ (n * slope * beta),
            "x0v": x1.T @ (n * slope), "q": (n[:, None] * q).sum(axis=0), "pi": (n[:, None] * pi).sum(axis=0),
            "beta": (n * beta).sum(), "beta2": (n * beta * beta).sum(), "side_n": sides.sum(axis=1),
            "side_beta": sides @ beta, "side_pi": sides @ pi}


def gate_table(rows: DataFrame, x: list[Column], p: list[Column], keys: list[str]) -> DataFrame:
    """Cached training table (day, n, clicks, grp01, early, keys, x, p), laid out by day so that a day's job reads only its part."""
    shaped = rows.select("day", F.col("n").cast("double").alias("n"), F.col("clicks").cast("double").alias("clicks"),
                         "grp01", "early", *[k for k in keys if k not in ("day", "grp01", "early")],
                         F.array(*[c.cast("double") for c in x]).alias("x"),
                         F.array(*[c.cast("double") for c in p]).alias("p"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # salted with a hash, so that one heavy day spans several partitions
    laid = shaped.repartitionByRange(n, "day", F.xxhash64("x")).sortWithinPartitions("day")
    # settled first: the many small jobs then plan against a short lineage
    return settle(laid).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Slice:
    """Rows of one update: a day, optionally its early part only, optionally with the tail of the day before."""
    day: int
    early_only: bool = False
    tail_of: int | None = None

    def mask(self, day: int, early: np.ndarray) -> np.ndarray | None:
        """Which rows of a day's block belong to the slice, if any."""
        if day == self.day:
            at = early if self.early_only else np.ones(len(early), dtype=bool)
        elif day == self.tail_of:
            at = ~early
        else:
            return None
        return at if at.any() else None


def _accumulate(total: dict, work, specs, x, p, n, k, g) -> None:
    for i, spec in enumerate(specs):
        part = work(i, x[:, list(spec.columns)], p[:, list(spec.experts)], n, k, g)
        for name, value in part.items():
            flat = np.atleast_1d(np.asarray(value, float)).ravel()
            total[i, name] = total[i, name] + flat if (i, name) in total else flat


def _collect(total: dict, specs) -> list[dict[str, np.ndarray]]:
    out: list[dict[str, np.ndarray]] = [{} for _ in specs]
    for (i, name), value in total.items():
        out[i][name] = value
    return out


def _day_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(day, n, clicks, grp01, early, x, p) -> one row of arrays for each day of a batch."""
    for pdf in batches:
        out = []
        for day, part in pdf.groupby("day"):
            arrays = (np.vstack(part["x"].to_numpy()), np.vstack(part["p"].to_numpy()), part["n"].to_numpy(),
                      part["clicks"].to_numpy(), part["grp01"].to_numpy(), part["early"].to_numpy(dtype=bool))
            out.append((int(day), pickle.dumps(arrays, protocol=5)))
        yield pd.DataFrame(out, columns=["day", "arrays"])


def _job_runner(table: DataFrame):
    """Sums over a slice as one job: every task sums its rows for all configurations, the driver adds the parts.

    The jobs are many and alike, so the table is turned into day blocks once and
    kept; a job is planned by hand, on the partitions that hold its days.
    """
    sc = table.sparkSession.sparkContext
    blocks = table.select("day", "n", "clicks", "grp01", "early", "x", "p").mapInPandas(_day_blocks, "day int, arrays binary").rdd.map(
        lambda r: (r["day"], pickle.loads(r["arrays"]))).persist(StorageLevel.MEMORY_AND_DISK)
    where: dict[int, set[int]] = {}
    for part, days in blocks.mapPartitionsWithIndex(lambda i, rows: [(i, sorted({day for day, _ in rows}))]).collect():
        for day in days:
            where.setdefault(day, set()).add(part)

    def run(rows: Slice, work, specs) -> list[dict[str, np.ndarray]]:
        def task(held: Iterator[tuple[int, tuple]]) -> list[dict]:
            total: dict[tuple[int, str], np.ndarray] = {}
            for day, (x, p, n, k, g, early) in held:
                at = rows.mask(day, early)
                if at is not None:
                    _accumulate(total, work, specs, *(a[at] for a in (x, p, n, k, g)))
            return [total]

        total: dict[tuple[int, str], np.ndarray] = {}
        for part in sc.runJob(blocks, task, sorted(where.get(rows.day, set()) | where.get(rows.tail_of, set()))):
            for key, value in part.items():
                total[key] = total[key] + value if key in total else value
        return _collect(total, specs)
    return run


def _replay(table: DataFrame, loop):
    """Run ``loop(days, run)`` with one job per gradient, whatever the size of the table."""
    days = sorted(r["day"] for r in table.select("day").distinct().collect())
    return loop(days, _job_runner(table))


def _sums(specs, thetas):
    def work(i, x, p, n, k, g):
        fn = pair_sums if specs[i].kind == "pair" else multi_sums
        return fn(thetas[i], x, p, n, k, specs[i])
    return work


def train_gates(table: DataFrame, specs: list[GateSpec]) -> dict[int, list[np.ndarray]]:
    """Parameters deployed on every day: fitted on strictly earlier days, zero on the first."""
    return _replay(table, lambda days, run: _gate_loop(days, run, specs))


def _gate_loop(days: list[int], run, specs: list[GateSpec]) -> dict[int, list[np.ndarray]]:
    sizes = [(len(s.columns) + 1) * (1 if s.kind == "pair" else len(s.experts)) for s in specs]
    theta = [np.zeros(z) for z in sizes]
    adam = [Adam(z, s.lr) for z, s in zip(sizes, specs)]
    before = [np.array([0.5]) if s.kind == "pair" else np.full(len(s.experts), 1.0 / len(s.experts)) for s in specs]
    deployed = {}
    for day in days:
        deployed[day] = [t.copy() for t in theta]
        today = Slice(day)
        for _ in range(max(s.epochs for s in specs)):
            parts = run(today, _sums(specs, [t.copy() for t in theta]), specs)
            for i, (s, part) in enumerate(zip(specs, parts)):
                n = part["n"][0]
                grad = part["grad"] / n + 2 * s.l2 * theta[i]
                if s.smooth:
                    sign = np.sign(part["mean"] / n - before[i])
                    turn = part["smooth"].reshape(len(sign), -1)
                    grad = grad + s.smooth * (sign[:, None] * turn).sum(axis=0) / n
                theta[i] = adam[i].move(theta[i], grad)
        if any(s.smooth for s in specs):
            parts = run(today, _sums(specs, [t.copy() for t in theta]), specs)
            before = [part["mean"] / part["n"][0] for part in parts]
    return deployed


def predict_gates(table: DataFrame, specs: list[GateSpec], deployed: dict[int, list[np.ndarray]],
                  keys: list[str]) -> DataFrame:
    """Deployed predictions of every configuration in one pass: (keys..., p_<name>..., w_<name> mean weight of the short expert or array)."""
    names = [s.name for s in specs]
    types = dict(table.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in ["day", *keys, "n", "clicks"]] + [f"p_{m} double" for m in names]
                       + [f"w_{m} array<double>" for m in names])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, p = np.vstack(pdf["x"].to_numpy()), np.vstack(pdf["p"].to_numpy())
            out = pdf[["day", *keys, "n", "clicks"]].copy()
            day = pdf["day"].to_numpy()
            for i, s in enumerate(specs):
                width = 2 if s.kind == "pair" else len(s.experts)
                mixed, weights = np.zeros(len(pdf)), np.zeros((len(pdf), width))
                for d in np.unique(day):
                    at = np.flatnonzero(day == d)
                    theta = deployed[int(d)][i]
                    x1, pp = _with_one(x[at][:, list(s.columns)]), p[at][:, list(s.experts)]
                    if s.kind == "pair":
                        a = _sigmoid(x1 @ theta)
                        w = np.stack([a, 1 - a], axis=1)
                    else:
                        w = _softmax(x1 @ theta.reshape(-1, pp.shape[1]))
                    mixed[at] = (w * pp).sum(axis=1)
                    weights[at] = w
                out[f"p_{s.name}"], out[f"w_{s.name}"] = mixed, list(weights)
            yield out[[c.split()[0] for c in schema.split(", ")]]

    return table.select("day", *keys, "n", "clicks", "x", "p").mapInPandas(task, schema)


STATE_SIZE = 11  # per-expert losses (5), disagreement, click rate, gate move, time, loss jump, distance q to m


def train_persistence(table: DataFrame, specs: list[PersistSpec], state: dict[int, dict]) -> list[dict]:
    """Replay of the adaptive-persistence gates; one trace row per (spec, day).

    ``state[day]`` holds the day-level inputs known before the day. ``matured``
    specs update on labels that arrived by midnight plus the previous day's
    tail, and move their memory before the gate step.
    """
    if any(s.matured for s in specs) and not all(s.matured for s in specs):
        raise ValueError("matured and immediate specs need separate replays")
    return _replay(table, lambda days, run: _persist_loop(days, run, specs, state))


def _persist_loop(days: list[int], run, specs: list[PersistSpec], state: dict[int, dict]) -> list[dict]:
    kk = [len(s.experts) for s in specs]
    par, adam = [], []
    for s, k in zip(specs, kk):
        width = (len(s.columns) + 1) * k
        m = np.full((2, k) if s.per_group else k, 1.0 / k)
        size = STATE_SIZE if s.state is None else len(s.state)
        r = np.zeros(size + 1)
        r[-1] = s.init_bias
        par.append({"w": np.zeros(width), "r": r, "xi": np.zeros(len(s.columns) + 1), "m": m, "logit": 0.0})
        adam.append({"w": Adam(width, s.lr), "r": Adam(size + 1, s.lr), "xi": Adam(len(s.columns) + 1, s.lr)})
    moved, last_pi, last_q = [0.0] * len(specs), [None] * len(specs), [None] * len(specs)
    trace, previous = [], None

    def snapshot():
        return [{k: (v.copy() if isinstance(v, np.ndarray) else v) for k, v in q.items()} for q in par]

    def work_with(frozen):
        def work(i, x, p, n, k, g):
            return persist_sums(frozen[i], x, p, n, k, g, specs[i])
        return work

    matured = any(s.matured for s in specs)
    for day in days:
        inputs = []
        for i, s in enumerate(specs):
            row = state[day]
            mean_m = par[i]["m"].mean(axis=0) if s.per_group else par[i]["m"]
            gap = 0.0 if last_q[i] is None else float(np.abs(last_q[i] - mean_m).sum())
            full = np.array([*row["losses"], row["disagreement"], row["ctr"], moved[i], row["norm_t"], row["jump"], gap])
            if previous is None and s.state is None:  # nothing is known yet; chosen inputs (the time) are
                full = np.zeros(STATE_SIZE)
            inputs.append(np.append(full if s.state is None else full[list(s.state)], 1.0))
            par[i]["logit"] = float(inputs[i] @ par[i]["r"])
        today = Slice(day)
        shown = run(today, work_with(snapshot()), specs)
        for i, (s, part) in enumerate(zip(specs, shown)):
            n = part["n"][0]
            pi, q, b = part["pi"] / n, part["q"] / n, part["beta"][0] / n
            move = None if last_pi[i] is None else float(np.abs(pi - last_pi[i]).sum())
            side = part["side_beta"] / np.where(part["side_n"] > 0, part["side_n"], np.nan)
            trace.append({"spec": s.name, "day": day, "loss": part["loss"][0] / n, "beta": b,
                          "beta_std": float(np.sqrt(max(part["beta2"][0] / n - b * b, 0.0))),
                          "beta_a": float(side[0]), "beta_b": float(side[1]), "pi": pi.tolist(), "move": move,
                          "params": {**snapshot()[i], "spec": s}})
            last_pi[i], last_q[i], moved[i] = pi, q, 0.0 if move is None else move
            if s.matured:
                par[i]["m"] = (1 - s.rho) * par[i]["m"] + s.rho * pi
        used = today
        if matured:
            used = Slice(day, True, previous if previous == day - 1 else None)
        for _ in range(max(s.epochs for s in specs)):
            parts = run(used, work_with(snapshot()), specs)
            for i, (s, part) in enumerate(zip(specs, parts)):
                if not part:
                    continue
                n = part["n"][0]
                if not s.uniform_q:
                    par[i]["w"] = adam[i]["w"].move(par[i]["w"], part["grad"] / n + 2 * s.l2 * par[i]["w"])
                if s.adaptive:
                    g_logit, g_xi = part["logit"][0] / n, part["xi"] / n
                    if s.per_example and s.beta_var and n > 1:
                        mean = part["beta"][0] / n
                        g_logit += s.beta_var * 2 * (part["v1"][0] - mean * part["v0"][0]) / (n - 1)
                        g_xi = g_xi + s.beta_var * 2 * (part["x1v"] - mean * part["x0v"]) / (n - 1)
                    par[i]["r"] = adam[i]["r"].move(par[i]["r"], g_logit * inputs[i] + 2 * s.l2 * par[i]["r"])
                    if s.per_example:
                        par[i]["xi"] = adam[i]["xi"].move(par[i]["xi"], g_xi + 2 * s.l2 * par[i]["xi"])
                    par[i]["logit"] = float(inputs[i] @ par[i]["r"])
        if not matured:
            parts = run(today, work_with(snapshot()), specs)
            for i, (s, part) in enumerate(zip(specs, parts)):
                if s.per_group:
                    for side in (0, 1):
                        if part["side_n"][side] > 0:
                            mean = part["side_pi"].reshape(2, -1)[side] / part["side_n"][side]
                            par[i]["m"][side] = (1 - s.rho) * par[i]["m"][side] + s.rho * mean
                else:
                    par[i]["m"] = (1 - s.rho) * par[i]["m"] + s.rho * part["pi"] / part["n"][0]
        previous = day
    return trace


def predict_persistence(table: DataFrame, trace: list[dict], keys: list[str]) -> DataFrame:
    """Deployed predictions of every spec in one pass: (day, keys..., n, clicks, p_<name>...)."""
    frozen: dict[str, dict[int, dict]] = {}
    for t in trace:
        frozen.setdefault(t["spec"], {})[t["day"]] = t["params"]
    types = dict(table.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in ["day", *keys, "n", "clicks"]] + [f"p_{m} double" for m in frozen])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, p = np.vstack(pdf["x"].to_numpy()), np.vstack(pdf["p"].to_numpy())
            day, group = pdf["day"].to_numpy(), pdf["grp01"].to_numpy()
            out = pdf[["day", *keys, "n", "clicks"]].copy()
            for name, by_day in frozen.items():
                mixed = np.zeros(len(pdf))
                for d in np.unique(day):
                    at, par = day == d, by_day[int(d)]
                    s = par["spec"]
                    pp = p[at][:, list(s.experts)]
                    *_, pi = persist_weights(s, par, x[at][:, list(s.columns)], pp.shape[1], group[at])
                    mixed[at] = (pp * pi).sum(axis=1)
                out[f"p_{name}"] = mixed
            yield out[[c.split()[0] for c in schema.split(", ")]]

    return table.select("day", *keys, "n", "clicks", "grp01", "x", "p").mapInPandas(task, schema)


def fit_simplex(tally: DataFrame, experts: list[str], by: str, max_iter: int = 300, rate: float = 4.0,
                tol: float = 1e-9) -> dict[int, np.ndarray]:
    """Constant simplex weights of each group ``by``, fitted by exponentiated gradient.

    ``tally``: (by, n, clicks, one column per expert). Weights are the softmax of
    accumulated steps; a group rests when its loss moves by less than ``tol``.
    The step's direction sum(p * (n * p.w - k)) is linear in the weights, so one
    job sums p p' and p k for all groups and the whole path follows from these
    on the driver. A second job has the loss of every weight on the path, which
    tells where each group rests.
    """
    rows = settle(tally.groupBy(by, *experts).agg(
        F.sum("n").cast("double").alias("n"), F.sum("clicks").cast("double").alias("clicks")).where("n > 0"))
    k = len(experts)
    paths = {}
    for r in _group_sums(rows, by, 1 + k * k + k, lambda group, part: _moments(part, experts)):
        weight, square, cross = r["sums"][0], np.array(r["sums"][1:1 + k * k]).reshape(k, k), np.array(r["sums"][1 + k * k:])
        scores, path = np.zeros(k), []
        for step in range(1, max_iter + 1):
            path.append(_softmax(scores[None, :])[0])
            scores = scores - rate / np.sqrt(step) * (square @ path[-1] - cross) / weight
        paths[r["grp"]] = (weight, np.array([*path, _softmax(scores[None, :])[0]]))
    out = {}
    for r in _group_sums(rows, by, max_iter, lambda group, part: _path_losses(part, experts, paths[group][1][:-1])):
        weight, path = paths[r["grp"]]
        still = np.abs(np.diff(np.array(r["sums"]) / weight)) < tol
        out[r["grp"]] = path[int(still.argmax()) + 2] if still.any() else path[-1]
    return out


def _group_sums(rows: DataFrame, by: str, width: int, sums) -> list:
    """(grp, sums) of every group: each task adds up its rows, Spark adds the tasks' sums."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for group, part in pdf.groupby(by):
                total[int(group)] = total.get(int(group), 0.0) + sums(int(group), part)
        yield pd.DataFrame({"grp": list(total), "sums": [v.tolist() for v in total.values()]})

    return rows.mapInPandas(task, "grp long, sums array<double>").groupBy("grp").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()


def _moments(pdf: pd.DataFrame, experts: list[str]) -> np.ndarray:
    """Weight, sum of n p p', sum of p k."""
    p, n, k = pdf[experts].to_numpy(), pdf["n"].to_numpy(), pdf["clicks"].to_numpy()
    return np.concatenate([[n.sum()], ((p * n[:, None]).T @ p).ravel(), p.T @ k])


def _path_losses(pdf: pd.DataFrame, experts: list[str], path: np.ndarray) -> np.ndarray:
    """Log loss of every weight on the path."""
    n, k = pdf["n"].to_numpy()[:, None], pdf["clicks"].to_numpy()[:, None]
    mixed = np.clip(pdf[experts].to_numpy() @ path.T, 1e-12, 1 - 1e-12)
    return -(k * np.log(mixed) + (n - k) * np.log(1 - mixed)).sum(axis=0)
