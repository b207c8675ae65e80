"""Features: hashing, dense context, signed sketches and the inputs of the gates."""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
from pyspark.ml.feature import FeatureHasher
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import hashing as hs
from tidelog.session import attach, running_total

HASH_WIDTH = 2 ** 18


def hashed_vector(df: DataFrame, columns: list[str], width: int = HASH_WIDTH, out: str = "features") -> DataFrame:
    """Hashing trick over "column=value" tokens; numeric categories are treated as categories."""
    hasher = FeatureHasher(numFeatures=width, inputCols=columns, outputCol=out, categoricalCols=columns)
    return hasher.transform(df)


def hash_codes(columns: list[str], vocab: int) -> Column:
    return F.array(*[hs.md5_tail_mod(hs.token(c, F.col(c)), vocab).cast("int") for c in columns])


def max_normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each code over its column maximum; a column without a positive code stays as it is."""
    top = df.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    scaled = [F.when(F.col(f"_max_{c}") > 0, F.col(c) / F.col(f"_max_{c}"))
              .otherwise(F.col(c).cast("double")).alias(f"ctx_{c}") for c in columns]
    return df.crossJoin(top).select(*df.columns, *scaled)


def sorted_codes(df: DataFrame, column: str) -> DataFrame:
    """Dimension (value, code, norm, n): rank of the distinct value in sorted order, over the largest code.

    The rank is a distributed running count, so the number of distinct values
    is not bounded by one task.
    """
    distinct = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = running_total(distinct.withColumn("_one", F.lit(1).cast("long")), [], [F.col("value")], {"_rank": "_one"})
    top = ranked.agg(F.max("_rank").alias("_top"))
    code = F.col("_rank") - 1
    return ranked.crossJoin(top).select(
        "value", code.alias("code"), "n",
        F.when(F.col("_top") > 1, code / (F.col("_top") - 1)).otherwise(0.0).alias("norm"))


def signed_sketch(columns: list[str], m: int, out: str = "sketch") -> Column:
    """m-dimensional signed hash sketch of the tokens, unit length (zero stays zero)."""
    hits = F.array(*[F.struct(
        hs.md5_tail_mod(hs.token(c, F.col(c)), m).alias("bucket"),
        F.when(hs.md5_int(hs.token(c, F.col(c)), 1) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")) for c in columns])

    def bucket_sum(found: Column, j: int) -> Column:
        return F.aggregate(found, F.lit(0.0),
                           lambda acc, t: acc + F.when(t["bucket"] == j, t["sign"]).otherwise(0.0))

    def project(found: Column) -> Column:
        return F.array(*[bucket_sum(found, j) for j in range(m)])

    def scale(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(F.when(norm > 0, norm).otherwise(1.0), lambda size: F.transform(raw, lambda x: x / size))

    return let(let(hits, project), scale).alias(out)


def let(value: Column, body) -> Column:
    """Bind a computed value to a name, so that it is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def previous_day(day_losses: DataFrame, by: str, experts: list[str], prefix: str = "recent_") -> DataFrame:
    """Loss of each expert on the latest earlier day of the bank (0 on the first day), one row per day."""
    wide = day_losses.groupBy("day").pivot(by, experts).agg(F.first("loss"))
    before = Window.orderBy("day")  # one row per calendar day
    return wide.select("day", *[F.coalesce(F.lag(e).over(before), F.lit(0.0)).alias(prefix + e) for e in experts])


def pair_features(wide: DataFrame, recent: DataFrame, short: str, long: str, last_day: int) -> DataFrame:
    """Inputs of the two-expert gate, without today's labels."""
    diff = F.col(short) - F.col(long)
    joined = attach(wide, recent.select("day", f"recent_{short}", f"recent_{long}"), ["day"])
    return joined.select(
        *wide.columns, F.abs(diff).alias("abs_diff"), diff.alias("diff"),
        (F.col("day") / max(last_day, 1)).alias("norm_t"), f"recent_{short}", f"recent_{long}")


def spread(experts: list[str]) -> Column:
    cols = [F.col(e) for e in experts]
    return F.greatest(*cols) - F.least(*cols)


def multi_features(wide: DataFrame, recent: DataFrame, experts: list[str], last_day: int) -> DataFrame:
    """Inputs of the K-expert gate: spread, normalised time, recent loss per expert."""
    joined = attach(wide, recent, ["day"])
    return joined.select(*wide.columns, spread(experts).alias("spread"),
                         (F.col("day") / max(last_day, 1)).alias("norm_t"),
                         *[F.col(f"recent_{e}") for e in experts])


def persistence_state(wide_tally: DataFrame, day_losses: DataFrame, by: str, experts: list[str],
                      short: str, long: str, last_day: int) -> DataFrame:
    """Day-level state seen on day t: losses, disagreement and click rate of the previous day, loss jump, time."""
    losses = day_losses.groupBy("day").pivot(by, experts).agg(F.first("loss"))
    daily = wide_tally.groupBy("day").agg(
        (F.sum(F.col("n") * F.abs(F.col(short) - F.col(long))) / F.sum("n")).alias("_dis"),
        (F.sum("clicks") / F.sum("n")).alias("_ctr"))
    w = Window.orderBy("day")  # one row per calendar day
    jump = F.greatest(*[F.abs(F.lag(e, 1).over(w) - F.lag(e, 2).over(w)) for e in experts])
    return losses.join(daily, "day").select(
        "day", *[F.coalesce(F.lag(e).over(w), F.lit(0.0)).alias(f"recent_{e}") for e in experts],
        F.coalesce(F.lag("_dis").over(w), F.lit(0.0)).alias("recent_disagreement"),
        F.coalesce(F.lag("_ctr").over(w), F.lit(0.0)).alias("recent_ctr"),
        F.coalesce(jump, F.lit(0.0)).alias("loss_jump"),
        F.when(F.lag("_ctr").over(w).isNull(), F.lit(0.0))
        .otherwise(F.col("day") / max(last_day, 1)).alias("norm_t"))


def hash_sign(side: str, i: int, j: int) -> float:
    """Entry (i, j) of a fixed random sign matrix."""
    return 1.0 if int(hashlib.md5(f"{side}:{i}:{j}".encode()).hexdigest()[0], 16) % 2 == 0 else -1.0


@cache
def sign_matrix(side: str, rows: int, cols: int) -> np.ndarray:
    return np.array([[hash_sign(side, i, j) for j in range(cols)] for i in range(rows)])


def interaction(a: list[Column], s: list[Column], cross_dim: int) -> Column:
    """[1, a, s, (a Ra) * (s Rs)] scaled to norm at most one, as an array expression (small dimensions)."""
    def project(side, cols, j):
        return reduce(lambda x, y: x + y, [c * hash_sign(side, i, j) for i, c in enumerate(cols)])

    cross = [project("a", a, j) * project("s", s, j) for j in range(cross_dim)]
    raw = F.array(F.lit(1.0), *a, *s, *cross)

    def bound(vec: Column) -> Column:
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(F.greatest(F.lit(1.0), norm), lambda size: F.transform(vec, lambda x: x / size))

    return let(raw, bound)


def interaction_matrix(a: np.ndarray, s: np.ndarray, ra: np.ndarray, rs: np.ndarray) -> np.ndarray:
    """The same features for a batch of rows inside a task."""
    phi = np.hstack([np.ones((len(a), 1)), a, s, (a @ ra) * (s @ rs)])
    return phi / np.maximum(1.0, np.linalg.norm(phi, axis=1, keepdims=True))
