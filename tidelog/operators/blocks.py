"""Within-day block history: tokens, causal summaries, and the as-of lookup of matured blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import hashing as hs
from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.session import attach

# Fixed order of the scalar token fields; the two sketch halves follow.
TOKEN_FIELDS = ["log1p_n", "mean_y", "mean_q", "mean_logit", "mean_r", "mean_abs_r", "mean_loss"]
LABEL_FIELDS = ["mean_y", "mean_r", "mean_abs_r", "mean_loss"]
HALF_LIVES = (1.0, 4.0, 16.0)


def block_calendar(days: DataFrame, block_sec: int) -> DataFrame:
    last = ta.blocks_per_day(block_sec) - 1
    return days.select("day", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))


def block_tokens(rows: DataFrame, block_sec: int, m: int) -> DataFrame:
    """One token per (day, block), zeros for an empty block: (day, block, u).

    ``rows``: (day, sec, click, q, sketch array of size m).
    """
    q, y = sc.clip(F.col("q"), sc.LOGIT_CLIP), F.col("click")
    r = y - q
    c = [F.col("sketch")[j] for j in range(m)]
    fields = [F.log1p(F.count("*")), F.avg(y), F.avg(q), F.avg(sc.logit(q)), F.avg(r), F.avg(F.abs(r)),
              F.avg(sc.log_loss(y, q))]
    fields += [F.avg(x) for x in c] + [F.avg(r * x) for x in c]
    seen = rows.groupBy("day", ta.block_of(F.col("sec"), block_sec).alias("block")).agg(
        F.array(*[f.cast("double") for f in fields]).alias("u"))
    calendar = block_calendar(rows.select("day").distinct(), block_sec)
    zeros = F.array(*[F.lit(0.0)] * len(fields))
    return calendar.join(seen, ["day", "block"], "left").withColumn("u", F.coalesce("u", zeros))


def ewma(seq: Column, half_life: float) -> Column:
    """Left-to-right EWMA of an array of vectors, started at the first one."""
    keep = 0.5 ** (1.0 / half_life)
    empty = F.expr("cast(array() as array<array<double>>)")

    def step(acc, u):
        prev = F.element_at(acc, -1)
        now = F.when(F.size(acc) == 0, u).otherwise(
            F.zip_with(u, prev, lambda x, p: (1.0 - keep) * x + keep * p))
        return F.concat(acc, F.array(now))

    return F.aggregate(seq, empty, step)


def causal_summary(tokens: DataFrame, half_lives=HALF_LIVES) -> DataFrame:
    """(day, block, u, prev, e1, e2, e3, diff): level and trend, each from blocks up to this one."""
    seq = F.sort_array(F.collect_list(F.struct("block", "u")))
    per_day = tokens.groupBy("day").agg(seq.alias("_s")).withColumn("_u", F.col("_s.u"))
    paths = per_day.select("day", F.col("_s.block").alias("block"), F.col("_u").alias("u"),
                           *[ewma(F.col("_u"), h).alias(f"e{i}") for i, h in enumerate(half_lives, 1)])
    names = [f"e{i}" for i in range(1, len(half_lives) + 1)]
    flat = paths.select("day", F.inline(F.arrays_zip("block", "u", *names)))
    w = Window.partitionBy("day").orderBy("block")
    zero = F.transform("u", lambda x: F.lit(0.0))
    with_prev = flat.withColumn("prev", F.coalesce(F.lag("u").over(w), zero))
    return with_prev.select("day", "block", "u", "prev", *names,
                            F.zip_with("u", "prev", lambda a, b: a - b).alias("diff"))


def summary_vector(summary: DataFrame, half_lives=HALF_LIVES) -> DataFrame:
    names = [f"e{i}" for i in range(1, len(half_lives) + 1)]
    return summary.select("day", "block", F.concat("u", "prev", *names, "diff").alias("s"))


def as_of(rows: DataFrame, history: DataFrame, block_sec: int, delay_sec: int) -> DataFrame:
    """Attach the history of the last matured block: an equi-join on a computed key."""
    k = ta.last_available_block(F.col("sec"), block_sec, delay_sec)
    return attach(rows.withColumn("k_avail", k), history.withColumnRenamed("block", "k_avail"), ["day", "k_avail"])


def recent_window(tokens: DataFrame, size: int) -> DataFrame:
    """For each block, the up to ``size`` tokens ending at it, oldest first: (day, block, window, filled)."""
    w = Window.partitionBy("day").orderBy("block").rowsBetween(-(size - 1), 0)
    seq = F.collect_list("u").over(w)
    return tokens.select("day", "block", seq.alias("window"), F.size(seq).alias("filled"))


def _zero_at(u: Column, positions: set[int]) -> Column:
    return F.transform(u, lambda x, i: F.when(i.isin(*positions), 0.0).otherwise(x))


def ablate(tokens: DataFrame, kind: str, m: int, seed: int = 0) -> DataFrame:
    """Token-level ablations; the block order placebo permutes blocks within the day by hash."""
    scalars = len(TOKEN_FIELDS)
    cross = set(range(scalars + m, scalars + 2 * m))
    labels = {TOKEN_FIELDS.index(f) for f in LABEL_FIELDS}
    if kind == "no_history":
        return tokens.withColumn("u", F.transform("u", lambda x: F.lit(0.0)))
    if kind == "no_residual_sketch":
        return tokens.withColumn("u", _zero_at(F.col("u"), cross))
    if kind == "label_free_history":
        return tokens.withColumn("u", _zero_at(F.col("u"), labels | cross))
    if kind == "shuffled_chronology":
        mixed = hs.md5_int(F.concat_ws(":", F.lit(str(seed)), F.col("day").cast("string"), F.col("block").cast("string")))
        by_hash = Window.partitionBy("day").orderBy(mixed, "block")
        moved = tokens.select("day", "u", (F.row_number().over(by_hash) - 1).cast("int").alias("block"))
        return moved.select("day", "block", "u")
    raise ValueError(f"unknown ablation {kind!r}")
