"""Queries: leakage and identity checks, run over the whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import timeaxis as ta
from tidelog.operators import auction as au
from tidelog.operators import calibrate as ca
from tidelog.operators import checks as ck
from tidelog.operators import history as hi
from tidelog.operators import mixing as mx
from tidelog.plans import auction_queries as aq
from tidelog.plans import fixtures as fx
from tidelog.plans import mixing_queries as mq
from tidelog.plans import within_queries as wq
from tidelog.plans.registry import query
from tidelog.session import settle
from tidelog.plans.sqlbase import BASE, CELLS, EXPERTS, IMP, LONG, sql
from tidelog.sources import sinks

CUT = 15


def _bank(log: DataFrame, matured: bool = False) -> DataFrame:
    return fx.eligible(hi.rate_bank(hi.cell_counts(log, ["campaign"]), ["campaign"], matured=matured))


@query("leak_flip_future", "Q1", sql(f"""
SELECT 'bank' AS "check", count(*) AS compared, CAST(0 AS BIGINT) AS differing FROM rates WHERE day BETWEEN 4 AND {CUT}
UNION ALL SELECT 'weights', count(DISTINCT day), 0 FROM rates WHERE day BETWEEN 4 AND {CUT}""", *BASE))
def leak_flip_future(spark, d) -> DataFrame:
    """Inverting every label from the cutoff day on changes no prediction and no weight up to that day."""
    log = fx.imp(spark, d)
    out = None
    banks, weights = [], []
    for rows in (log, ck.flip(log, F.col("day") >= CUT)):
        bank = _bank(rows)
        banks.append(bank.filter(F.col("day") <= CUT))
        losses = fx.day_losses(hi.long_bank(bank, EXPERTS, ["day", "n", "clicks"]))
        w = mx.fixed_share(losses, len(EXPERTS))
        weights.append(w.select("day", *[F.col("w")[i].alias(e) for i, e in enumerate(EXPERTS)])
                       .filter(F.col("day") <= CUT))
    for name, (a, b), keys in (("bank", banks, ["campaign", "day"]), ("weights", weights, ["day"])):
        part = ck.tally(name, ck.differing(a, b, keys, EXPERTS))
        out = part if out is None else out.unionByName(part)
    return out


@query("leak_unmatured_tail", "Q2", sql(f"""
SELECT c.campaign, c.day, c.day >= {CUT + 2} AND coalesce(t.n_tail <> 2 * t.k_tail, false) AS changed
FROM cells c LEFT JOIN cells t ON t.campaign = c.campaign AND t.day = {CUT} WHERE c.day >= 4""", IMP, CELLS))
def leak_unmatured_tail(spark, d) -> DataFrame:
    """Inverting a day's unmatured tail leaves that day and the next alone and reaches the day after."""
    log = fx.imp(spark, d)
    tail = (F.col("day") == CUT) & ~ta.matured_by_midnight(F.col("sec"))
    return ck.differing(_bank(log, True), _bank(ck.flip(log, tail), True), ["campaign", "day"], EXPERTS)


@query("simplex_check", "Q3", sql("""
SELECT m AS method, (SELECT count(DISTINCT day) FROM dl) AS compared, CAST(0 AS BIGINT) AS differing
FROM (VALUES ('fixed_share'), ('softmax_ema'), ('discounted')) v(m)""", *LONG))
def simplex_check(spark, d) -> DataFrame:
    """Weights are non-negative and sum to one on every day."""
    losses = fx.day_losses(fx.expert_tally(spark, d))
    tables = {"fixed_share": mx.fixed_share(losses, len(EXPERTS)),
              "softmax_ema": mx.ema_of_softmax(losses, len(EXPERTS), 0.75),
              "discounted": mq.hedge_weights(spark, d, [(60.0, 5.0)])}
    total = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    bad = (F.array_min("w") < 0) | (F.abs(total - 1.0) > 1e-9)
    out = None
    for name, w in tables.items():
        part = ck.tally(name, w.select(bad.alias("changed"))).withColumnRenamed("check", "method")
        out = part if out is None else out.unionByName(part)
    return out


@query("identity_check", "Q4", sql("""
SELECT 'first block keeps the prediction' AS "check", count(DISTINCT day) * 3 AS compared, CAST(0 AS BIGINT) AS differing FROM bank
UNION ALL SELECT 'zero learning rate', (SELECT count(*) FROM (SELECT DISTINCT day, sec // 3600 FROM bank)), 0
UNION ALL SELECT 'no adaptive mass', (SELECT count(*) FROM (SELECT DISTINCT day, sec // 3600 FROM bank)), 0
UNION ALL SELECT 'blend endpoints', count(DISTINCT day) * 2, 0 FROM bank""", *BASE))
def identity_check(spark, d) -> DataFrame:
    """Endpoints that must reproduce a simpler method exactly."""
    st = wq.stats(spark, d)
    path = ca.ops_path(st, [*wq.OPS_CONFIGS, ca.OpsConfig("frozen", eta0=0.0, platt=True)])
    moved = ((F.col("a") != 1.0) | (F.col("b") != 0.0)).alias("changed")
    first = Window.partitionBy("cfg", "day").orderBy("block")
    opening = path.filter("cfg <> 'frozen'").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(moved)
    share = ca.share_path(wq.anchor_losses(spark, d), wq.SHARE_CONFIGS[2:], wq.BLOCK, wq.DELAY)
    grid = mx.blend_grid(fx.wide_cells(spark, d), hi.SHORT, hi.LONG, steps=2)
    ends = grid.select("day", F.when(F.col("alpha") == 1.0, hi.SHORT).otherwise(hi.LONG).alias("expert"),
                       (F.col("s") / F.col("n")).alias("loss"))
    losses = fx.day_losses(fx.expert_tally(spark, d)).filter(F.col("expert").isin(hi.SHORT, hi.LONG))
    parts = [ck.tally("first block keeps the prediction", opening),
             ck.tally("zero learning rate", path.filter("cfg = 'frozen'").select(moved)),
             ck.tally("no adaptive mass", share.select((F.col("w0") != 1.0).alias("changed"))),
             ck.tally("blend endpoints", ck.differing(ends, losses, ["day", "expert"], ["loss"], 1e-9))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("bounds_check", "Q5", sql("""
SELECT 'intercept' AS "check", count(*) * 3 AS compared, CAST(0 AS BIGINT) AS differing FROM (SELECT DISTINCT day, sec // 3600 FROM bank)
UNION ALL SELECT 'newton', count(*) * 2, 0 FROM (SELECT DISTINCT day, sec // 3600 FROM bank)""", *BASE))
def bounds_check(spark, d) -> DataFrame:
    """Calibration states stay inside their box."""
    st = wq.stats(spark, d)
    ops = ca.ops_path(st, wq.OPS_CONFIGS)
    ons = ca.ons_path(st, wq.ONS_CONFIGS, wq.BLOCK, wq.DELAY)
    out_a = (F.abs("b") > 1.0) | (F.col("a") < 0.2) | (F.col("a") > 5.0)
    out_b = (F.abs("b") > 0.25) | (F.col("a") < 0.2) | (F.col("a") > 5.0)
    return ck.tally("intercept", ops.select(out_a.alias("changed"))).unionByName(
        ck.tally("newton", ons.select(out_b.alias("changed"))))


@query("monotone_frontier", "Q6", sql("""
SELECT e AS method, CAST(c AS BIGINT) AS compared, CAST(0 AS BIGINT) AS differing
FROM (VALUES ('roll1', 40), ('roll3', 40), ('roll7', 40), ('roll14', 40), ('expanding', 40), ('uniform5', 40), ('perfect', 18)) v(e, c)"""))
def monotone_frontier(spark, d) -> DataFrame:
    """Spend and clicks never fall as the bid scale rises; at equal spend, perfect foresight wins no fewer clicks than any method."""
    rows = aq.bids(spark, d)
    fr = settle(au.linear_frontier(rows, ["method"]))
    w = Window.partitionBy("method").orderBy("step")
    falls = (F.col("spend") < F.lag("spend", 1, 0.0).over(w)) | (F.col("clicks") < F.lag("clicks", 1, 0).over(w))
    steps = fr.withColumn("changed", falls).groupBy("method").agg(
        F.count("*").alias("compared"), F.count_if("changed").alias("differing"))
    anchors = au.reference_bidders(rows.filter(F.col("method") == "expanding").drop("method")).filter(F.col("bidder") == "perfect")
    targets = settle(aq._targets(spark, d))
    best = au.value_at_spend(au.linear_frontier(anchors, ["bidder"]), ["bidder"], targets, clamp_left=True)
    shown = au.value_at_spend(fr, ["method"], targets, clamp_left=True).select("method", "fraction", F.col("clicks_at").alias("won"))
    beaten = shown.join(best.select("fraction", "clicks_at"), "fraction").agg(
        F.lit("perfect").alias("method"), F.count("*").alias("compared"), F.count_if(F.col("won") > F.col("clicks_at") + 1e-6).alias("differing"))
    return steps.unionByName(beaten)


@query("row_alignment", "Q7", sql("""
SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differing FROM bank""", *BASE))
def row_alignment(spark, d) -> DataFrame:
    """Predictions and log meet one to one."""
    log = fx.eligible(fx.imp(spark, d)).select("row_id")
    bad = sinks.misaligned(fx.bank_rows(spark, d).select("row_id"), log).agg(F.count("*").alias("differing"))
    return log.agg(F.count("*").alias("compared")).crossJoin(bad)


@query("permutation_check", "Q8", sql("""
SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differing FROM bank""", *BASE))
def permutation_check(spark, d) -> DataFrame:
    """The chronology placebo deals out exactly the rows it was given."""
    rows = wq.q_rows(spark, d).select("row_id", "day", "sec", "click", "q")
    dealt = ca.shuffle_within_day(rows, ["click", "q"], seed=7)
    bad = ck.permutation(rows.select("day", "row_id", "click", "q"),
                         dealt.select("day", F.col("from_row").alias("row_id"), "click", "q"))
    return rows.agg(F.count("*").alias("compared")).crossJoin(bad.agg(F.count("*").alias("differing")))
