"""Queries: fitted click models, adapters, the calibration suites and the nested study."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import adapter as ad
from tidelog.operators import calibrate as ca
from tidelog.operators import online as on
from tidelog.operators import history as hi
from tidelog.operators import learners as le
from tidelog.operators import selection as se
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans import within_queries as wq
from tidelog.plans.feature_queries import TOKEN_COLUMNS
from tidelog.plans.history_queries import _bounds
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import EXPERTS
from tidelog.session import settle

WIDTH = 2 ** 18


def tallies(spark, d) -> DataFrame:
    log = fx.imp(spark, d).withColumn("early", ta.matured_by_midnight(F.col("sec")))
    return le.feature_tallies(log, TOKEN_COLUMNS, ["early"])


@query("fit_predict", "H6")
def fit_predict(spark, d) -> DataFrame:
    """All eight history rules fitted for every eligible day, with the loss of each; null where a rule has nothing to fit."""
    days = [r["day"] for r in fx.eligible(sp.day_axis(fx.cells(spark, d))).select("day").collect()]
    rules = {e: (h, None) for e, h in hi.HORIZONS.items()} | {e: (None, float(h)) for e, h in hi.HALF_LIVES.items()}
    scored = le.fit_rules(tallies(spark, d), sorted(days), rules, TOKEN_COLUMNS, width=WIDTH)
    return scored.groupBy("day", F.col("rule").alias("expert")).agg(
        F.sum("n").alias("n"), r6(F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))) / F.sum("n"), "loss"))


@query("forgetting_fit", "H10")
def forgetting_fit(spark, d) -> DataFrame:
    """Forgetting rate learned with the fitted model for every day, its half-life, and the day's loss; nulls where history is short."""
    days = sorted(r["day"] for r in sp.day_axis(fx.cells(spark, d)).select("day").collect())
    rates, scored = le.fit_forgetting(tallies(spark, d), days, TOKEN_COLUMNS, width=WIDTH)
    loss = F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))) / F.sum("n")
    by_day = scored.groupBy("t").agg(F.sum("n").alias("n"), r6(loss, "loss"))
    return rates.join(by_day, "t", "left").select("t", r6("eta"), r6("half_life"), "n", "loss")


def _fitted(spark, d, matured: bool) -> DataFrame:
    bounds = fx.eligible(_bounds(spark, d))
    fits = le.fit_bank(tallies(spark, d), bounds.select("day", "lo", "hi").distinct(), TOKEN_COLUMNS,
                       matured=matured, prior_fallback=matured, width=WIDTH)
    return bounds.join(settle(fits), ["day", "lo", "hi"])


def _by_day(bank: DataFrame) -> DataFrame:
    return bank.groupBy("day", "expert").agg(
        F.sum("n").alias("n"), F.max("n_train").alias("n_train"),
        r6(F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))) / F.sum("n"), "loss"))


@query("candidate_bank", "H7")
def candidate_bank(spark, d) -> DataFrame:
    """Fitted bank: every window on every eligible day, equal windows fitted once."""
    return _by_day(_fitted(spark, d, matured=False))


@query("matured_bank", "H8")
def matured_bank(spark, d) -> DataFrame:
    """The same on labels that had arrived by midnight, with the matured rate where no fit is possible."""
    return _by_day(_fitted(spark, d, matured=True))


SUITE_BLOCK, SUITE_DELAY = 3600, 1800


def calibration_suite(st: DataFrame, share: list[ca.ShareConfig]) -> DataFrame:
    """Daily losses of the calibration arms on one frozen prediction: (method, day, n, loss)."""
    st = settle(st)
    ops = [ca.OpsConfig("ops", eta0=0.2, platt=True), ca.OpsConfig("ops_flat", eta0=0.2)]
    ons = [ca.OnsConfig("short", 4.0), ca.OnsConfig("long", 16.0), ca.OnsConfig("reset_ons", 4.0, reset_daily=True),
           ca.OnsConfig("short_flat", 4.0, learn_slope=False), ca.OnsConfig("long_flat", 16.0, learn_slope=False)]
    paths = ca.ops_path(st, ops).select("cfg", "day", "block", "a", "b").unionByName(
        ca.ons_path(st, ons, SUITE_BLOCK, SUITE_DELAY).select("cfg", "day", "block", "a", "b"))
    paths = settle(paths)
    names = [c.name for c in [*ops, *ons]]
    wide = paths.withColumn("v", F.struct("a", "b")).groupBy("day", "block").pivot("cfg", names).agg(F.first("v"))
    cells = settle(st.groupBy("day", "block", "z").agg(F.sum("n").alias("n"), F.sum("clicks").alias("clicks"))
                   .join(wide, ["day", "block"]))
    cells = cells.select("day", "block", "n", "clicks", *[
        ca.corrected(F.col("z"), F.col(c)["a"], F.col(c)["b"]).alias(c) for c in names])
    n, k = F.col("n"), F.col("clicks")

    def losses(col):
        return F.sum(sc.tally_loss(n, k, col))

    out = None
    for label, trio in (("", ["ops", "short", "long"]), ("_flat", ["ops_flat", "short_flat", "long_flat"])):
        per_block = cells.groupBy("day", "block").agg(*[(losses(F.col(c)) / F.sum("n")).alias(f"l{i}")
                                                        for i, c in enumerate(trio)])
        path = ca.share_path(per_block, share, SUITE_BLOCK, SUITE_DELAY)
        mixed = cells.join(path, ["day", "block"])
        p = sum((F.col(f"w{i}") * F.col(c) for i, c in enumerate(trio)), F.lit(0.0))
        part = mixed.groupBy(F.concat("cfg", F.lit(label)).alias("method"), "day").agg(
            F.sum("n").alias("n"), (losses(p) / F.sum("n")).alias("loss"))
        out = part if out is None else out.unionByName(part)
    plain = cells.groupBy("day").agg(F.sum("n").alias("n"), *[(losses(F.col(c)) / F.sum("n")).alias(c) for c in names])
    plain = plain.select("day", "n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("method"), F.col(c).alias("loss")) for c in names])))
    return out.unionByName(plain.select("method", "day", "n", "loss"))


@query("calibration_suite", "C9")
def calibration_suite_query(spark, d) -> DataFrame:
    share = [ca.ShareConfig("anchored"), ca.ShareConfig("anchor_only", adaptive_mass=0.0)]
    out = calibration_suite(wq.stats(spark, d, block=SUITE_BLOCK, delay=SUITE_DELAY), share)
    return out.select("method", "day", F.col("n").cast("long").alias("n"), r6("loss"))


@query("calib_ablations", "C17")
def calib_ablations(spark, d) -> DataFrame:
    """One change at a time against the base calibration: loss per variant over all days."""
    base = ca.OpsConfig("base")
    arms = [("base", {}, base), ("platt", {}, ca.OpsConfig("platt", platt=True)),
            ("carry", {}, ca.OpsConfig("carry", carry=0.5)), ("delay_0", {"delay": 0}, base),
            ("delay_7200", {"delay": 7200}, base), ("block_1800", {"block": 1800}, base),
            ("short_backbone", {"p": "roll3"}, base)]
    out = None
    for label, changed, config in arms:
        st = wq.stats(spark, d, **changed)
        part = ca.scored_blocks(st, ca.ops_path(st, [config])).withColumn("variant", F.lit(label))
        out = part if out is None else out.unionByName(part)
    rows = wq.q_rows(spark, d).select("row_id", "day", "sec", "click", "q")
    mixed = ca.block_stats(ca.shuffle_within_day(rows, ["click", "q"], seed=7), wq.BLOCK, wq.DELAY)
    placebo = ca.scored_blocks(mixed, ca.ops_path(mixed, [base])).withColumn("variant", F.lit("placebo"))
    out = out.unionByName(placebo)
    return out.groupBy("variant").agg(F.sum("n").cast("long").alias("n"), r6(F.sum("s") / F.sum("n"), "loss"))


LEARNER_M, LEARNER_CROSS = 4, 8
ADAPTER_M = 4


def _learner(spark, d) -> DataFrame:
    return settle(on.learner_rows(wq.token_rows(spark, d, m=LEARNER_M), wq.BLOCK, wq.DELAY, LEARNER_M))


@query("online_learner", "C14")
def online_learner(spark, d) -> DataFrame:
    """Projected online gradient on context-by-history features: daily loss and final weight norm."""
    rows = _learner(spark, d)
    path = settle(on.weight_path(rows, wq.BLOCK, LEARNER_CROSS, 1.0))
    scored = on.predict(rows, path, LEARNER_CROSS)
    loss = scored.groupBy("day").agg(F.count("*").alias("n"), r6(F.avg(sc.log_loss(F.col("click"), F.col("p"))), "loss"))
    last = path.filter(F.col("block") == ta.blocks_per_day(wq.BLOCK) - 1)
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x * x))
    return loss.join(last.select("day", r6(norm, "norm")), "day")


ADAPTER_GRID = [ad.Setting(c, r) for c in (16, 32, 64) for r in (0.3, 0.03)]


@query("linear_adapter", "C15")
def linear_adapter(spark, d) -> DataFrame:
    """Rolling offset regression: every day deploys the setting chosen on its three latest inner days, fitted on all days before."""
    rows = on.learner_rows(wq.token_rows(spark, d, m=ADAPTER_M), wq.BLOCK, wq.DELAY, ADAPTER_M)
    out = ad.rolling_adapter(rows, ADAPTER_GRID)
    return out.select("day", "n", "n_inner", "cross", "reg", *[r6(c) for c in ("inner_score", "loss", "loss_no_history", "loss_frozen")])


NESTED_OPS = [ca.OpsConfig(f"e{e}_{'p' if p else 'i'}", eta0=e, platt=p) for e in (0.05, 0.2) for p in (False, True)]


@query("nested_passes", "O6")
def nested_passes(spark, d) -> DataFrame:
    """Nested study: window per origin, then its calibration, then the origin day scored once.

    Every stage is one table over (origin, configuration); the next stage only
    sees the choice, and choices rest on labels matured by the origin.
    """
    days = sp.day_axis(fx.cells(spark, d))
    pairs = settle(sp.inner_days(days, days.filter(F.col("day") >= fx.first_test(spark, d)), 3, fx.FIRST_ELIGIBLE)
                   .select("origin", "inner_day"))
    early = ta.matured_by_midnight(F.col("sec"))
    log = fx.eligible(fx.imp(spark, d)).withColumn("early", early)
    rate = hi.rate_bank(fx.cells(spark, d), ["campaign"], matured=True).select("campaign", "day", *EXPERTS)
    rows = log.join(rate, ["campaign", "day"])
    long = hi.long_bank(rows, EXPERTS, ["day", "sec", "early", "click"])
    n, k = F.lit(1), F.col("click")
    daily = settle(long.groupBy("expert", "ord", "day", "early").agg(
        F.count("*").alias("n"), F.sum(sc.tally_loss(n, k, F.col("p"))).alias("s")))
    # pass 1: the window of every origin
    window = se.lowest(se.inner_losses(pairs, daily, ["expert", "ord"]), ["origin"], "loss", ["ord"])
    window = settle(window.select("origin", "expert", F.col("loss").alias("window_loss")))
    # pass 2: calibration of that window
    wanted = window.select("expert").distinct()
    streams = long.join(F.broadcast(wanted), "expert")
    sec = F.col("sec")
    st = settle(streams.groupBy("expert", "early", "day", ta.block_of(sec, wq.BLOCK).alias("block"),
                                ta.update_block(sec, wq.BLOCK, wq.DELAY).alias("upd"),
                                F.round(sc.logit(F.col("p")), 12).alias("z"))
                .agg(F.count("*").cast("double").alias("n"), F.sum("click").cast("double").alias("clicks")))
    path = settle(ca.ops_path(st, NESTED_OPS, keys=["expert"]))
    joined = st.join(path.select("expert", "cfg", "day", "block", "a", "b"), ["expert", "day", "block"])
    p = ca.corrected(F.col("z"), F.col("a"), F.col("b"))
    scored = settle(joined.groupBy("expert", "cfg", "day", "early").agg(
        F.sum("n").alias("n"), F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), p)).alias("s")))
    inner = se.inner_losses(pairs, scored, ["expert", "cfg"]).join(window, ["origin", "expert"])
    chosen = settle(se.lowest(inner, ["origin"], "loss", ["cfg"]))
    # pass 3: the origin day itself, once
    today = scored.groupBy("expert", "cfg", F.col("day").alias("origin")).agg((F.sum("s") / F.sum("n")).alias("origin_loss"))
    return chosen.join(today, ["origin", "expert", "cfg"]).select(
        "origin", "expert", "cfg", r6("window_loss"), r6("loss", "inner_loss"), r6("origin_loss"))
