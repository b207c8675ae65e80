"""Exact quantiles without a sort and without collecting values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import literal_rows, settle


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    bins: int = 1024) -> dict[tuple, list[float]]:
    """Linearly interpolated quantiles per key, by repeated histogram refinement.

    Each pass counts the rows of every open bracket in ``bins`` bins (log-spaced when
    positive) and keeps the bin that holds the wanted rank, down to its true min and max.
    The driver sees at most brackets x bins counts, however large or skewed a
    key is; heavy ties end at once because their bin has min = max.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    base = df.select(*keys, F.col(value).cast("double").alias("_v"))
    base = settle(base)
    totals = base.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    found: dict[tuple, float] = {}
    open_: dict[tuple, dict] = {}
    sizes: dict[tuple, int] = {}
    for r in totals.collect():
        key = tuple(r[k] for k in keys)
        sizes[key] = r["n"]
        for p in probs:
            pos = p * (r["n"] - 1)
            for rank in {math.floor(pos), math.ceil(pos)}:
                open_[(key, rank)] = {"lo": r["lo"], "hi": r["hi"], "below": 0}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["_rank long", "_lo double", "_hi double"])
    while open_:
        for target in [t for t, s in open_.items() if s["lo"] == s["hi"]]:
            found[target] = open_.pop(target)["lo"]
        if not open_:
            break
        brackets = literal_rows(spark, [(*key, rank, s["lo"], s["hi"]) for (key, rank), s in open_.items()], schema)
        inside = base.join(F.broadcast(brackets), keys) if keys else base.crossJoin(F.broadcast(brackets))
        inside = inside.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        share = F.when(lo > 0, F.log(v / lo) / F.log(hi / lo)).otherwise((v - lo) / (hi - lo))
        cell = F.least(F.floor(share * bins), F.lit(bins - 1))
        counts = inside.groupBy(*keys, "_rank", cell.alias("_bin")).agg(
            F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b")).collect()
        per_target: dict[tuple, list] = {}
        for r in counts:
            per_target.setdefault((tuple(r[k] for k in keys), r["_rank"]), []).append((r["_bin"], r["c"], r["a"], r["b"]))
        for target, cells in per_target.items():
            state, seen = open_[target], open_[target]["below"]
            for _, count, a, b in sorted(cells):
                if target[1] < seen + count:
                    state.update(lo=a, hi=b, below=seen)
                    if target[1] == seen:
                        state.update(hi=a)
                    elif target[1] == seen + count - 1:
                        state.update(lo=b)
                    break
                seen += count
    out = {}
    for key, n in sizes.items():
        values = []
        for p in probs:
            pos = p * (n - 1)
            a, b = found[(key, math.floor(pos))], found[(key, math.ceil(pos))]
            values.append(a + (b - a) * (pos - math.floor(pos)))
        out[key] = values
    return out
