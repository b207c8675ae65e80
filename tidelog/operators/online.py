"""Within-day online learner on bounded context-by-history features, restarted every day."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import blocks as bl
from tidelog.operators.features import interaction_matrix, sign_matrix
from tidelog.session import attach, literal_rows, settle


def learner_rows(rows: DataFrame, block_sec: int, delay_sec: int, m: int) -> DataFrame:
    """(row_id, day, block, upd, click, z, a, s): context and the summary of the last matured block.

    ``rows``: (row_id, day, sec, click, q, sketch).
    """
    tokens = bl.block_tokens(rows, block_sec, m)
    history = bl.summary_vector(bl.causal_summary(tokens))
    joined = bl.as_of(rows, history, block_sec, delay_sec)
    z = sc.logit(F.col("q"))
    width = (len(bl.TOKEN_FIELDS) + 2 * m) * (3 + len(bl.HALF_LIVES))
    zeros = F.array_repeat(F.lit(0.0), width)
    return joined.select(
        "row_id", "day", ta.block_of(F.col("sec"), block_sec).alias("block"),
        ta.update_block(F.col("sec"), block_sec, delay_sec).alias("upd"), F.col("click").cast("double").alias("click"),
        z.alias("z"), F.concat("sketch", F.array(z, F.col("sec") / float(ta.SECONDS_PER_DAY))).alias("a"),
        F.coalesce("s", zeros).alias("s"))


def _phi(pdf: pd.DataFrame, cross: int) -> np.ndarray:
    a, s = np.vstack(pdf["a"].to_numpy()), np.vstack(pdf["s"].to_numpy())
    return interaction_matrix(a, s, sign_matrix("a", a.shape[1], cross), sign_matrix("s", s.shape[1], cross))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def _advance(w: np.ndarray, grad: np.ndarray, step: int, radius: float) -> np.ndarray:
    w = w - radius / math.sqrt(step) * grad
    size = np.linalg.norm(w)
    return w * (radius / size) if size > radius else w


PATH = "day int, block int, w array<double>"


def weight_path(table: DataFrame, block_sec: int, cross: int, radius: float) -> DataFrame:
    """Weights used in every block of every day; zero until the first labels mature.

    Days are independent, so one job per block moves all of them together.
    """
    n_blocks = ta.blocks_per_day(block_sec)
    spark = table.sparkSession
    cached = settle(table.repartitionByRange("upd", "day", "row_id")).persist(StorageLevel.MEMORY_AND_DISK)
    width = len(cached.select("a").first()["a"]) + len(cached.select("s").first()["s"]) + 1 + cross
    w = {r["day"]: np.zeros(width) for r in cached.select("day").distinct().collect()}
    step = dict.fromkeys(w, 0)
    path = []
    for block in range(n_blocks):
        path += [(int(d), block, v.tolist()) for d, v in w.items()]
        sums = cached.filter(F.col("upd") == block).mapInPandas(
            _block_task(w, cross), "day int, n long, g array<double>").collect()
        total: dict[int, tuple[int, np.ndarray]] = {}
        for r in sums:
            n, g = total.get(r["day"], (0, 0.0))
            total[r["day"]] = (n + r["n"], g + np.array(r["g"]))
        for day, (n, g) in total.items():
            step[day] += 1
            w[day] = _advance(w[day], g / n, step[day], radius)
    cached.unpersist()
    return literal_rows(spark, path, PATH)


def _block_task(w: dict[int, np.ndarray], cross: int):
    """Partial gradients of a task per day, with the current weights in the closure."""
    frozen = {d: v.copy() for d, v in w.items()}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            phi, day = _phi(pdf, cross), pdf["day"].to_numpy()
            z, y = pdf["z"].to_numpy(), pdf["click"].to_numpy()
            for d in np.unique(day):
                at = day == d
                resid = _sigmoid(z[at] + phi[at] @ frozen[int(d)]) - y[at]
                have = total.setdefault(int(d), [0, 0.0])
                have[0] += int(at.sum())
                have[1] = have[1] + phi[at].T @ resid
        if total:
            yield pd.DataFrame([(d, n, g.tolist()) for d, (n, g) in total.items()], columns=["day", "n", "g"])
    return task


def predict(table: DataFrame, path: DataFrame, cross: int) -> DataFrame:
    """(row_id, day, click, p): rows joined to the weights used in their block."""
    joined = attach(table, path, ["day", "block"], "inner", broadcast_rows=50_000)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            w = np.vstack(pdf["w"].to_numpy())
            out = pdf[["row_id", "day", "click"]].copy()
            out["p"] = _sigmoid(pdf["z"].to_numpy() + (_phi(pdf, cross) * w).sum(axis=1))
            yield out

    return joined.select("row_id", "day", "click", "z", "a", "s", "w").mapInPandas(
        task, "row_id long, day int, click double, p double")


def feature_vectors(table: DataFrame, cross: int) -> DataFrame:
    """The learner's features as an array column ``phi`` beside the row's key, label and logit."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = pdf[["row_id", "day", "click", "z"]].copy()
                out["phi"] = list(_phi(pdf, cross))
                yield out

    return table.mapInPandas(task, "row_id long, day int, click double, z double, phi array<double>")
