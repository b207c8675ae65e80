"""Queries: history rules, rate experts and the flagship window report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.operators import diagnostics as dg
from tidelog.operators import history as hi
from tidelog.operators import mixing as mx
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, CELLS, EXPERTS, IMP, LEN, LONG, rates, sql
from tidelog.session import settle

_REG = ", ".join(f"('{e}', {i}, {LEN[e] if LEN[e] < 1000 else 'NULL'}, CAST(NULL AS INTEGER))"
                 for i, e in enumerate(EXPERTS))
_REG += ", " + ", ".join(f"('decay{h}', {5 + i}, NULL, {h})" for i, h in enumerate([1, 3, 7]))
REG = f"reg AS (SELECT * FROM (VALUES {_REG}) r(expert, ord, win, hl))"
BOUNDS = """bounds AS (SELECT d.day, r.expert, r.ord,
  CAST(CASE WHEN r.win IS NULL THEN 0 ELSE greatest(0, d.day - r.win) END AS INTEGER) AS lo, d.day AS hi
  FROM (SELECT DISTINCT day FROM imp) d CROSS JOIN reg r WHERE r.hl IS NULL)"""


def _bounds(spark, d) -> DataFrame:
    return hi.history_bounds(sp.day_axis(fx.cells(spark, d)).select("day"), hi.expert_registry(spark))


def _volume(spark, d, names: list[str]) -> DataFrame:
    days = sp.day_axis(fx.cells(spark, d))
    out = hi.training_volume(days, _bounds(spark, d).filter(F.col("expert").isin(names)))
    return out.select("day", "expert", "n_train")


def _volume_sql(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return sql(f"""SELECT b.day, b.expert, (SELECT count(*) FROM imp i WHERE i.day >= b.lo AND i.day < b.hi) AS n_train
                   FROM bounds b WHERE b.expert IN ({listed})""", IMP, REG, BOUNDS)


@query("expanding_rule", "H1", _volume_sql(["expanding"]))
def expanding_rule(spark, d) -> DataFrame:
    return _volume(spark, d, ["expanding"])


@query("rolling_rule", "H2", _volume_sql(["roll1", "roll3", "roll7", "roll14"]))
def rolling_rule(spark, d) -> DataFrame:
    return _volume(spark, d, ["roll1", "roll3", "roll7", "roll14"])


_DECAY = ", ".join(f"""round((coalesce(sum(h.k * exp(-ln(2.0) / {x} * (c.day - h.day))), 0) + 0.8)
  / (coalesce(sum(h.n * exp(-ln(2.0) / {x} * (c.day - h.day))), 0) + 2.0), 6) AS decay{x}""" for x in (1, 3, 7))


@query("decay_rule", "H3", sql(f"""
SELECT c.campaign, c.day, {_DECAY} FROM cells c LEFT JOIN cells h ON h.campaign = c.campaign AND h.day < c.day
GROUP BY c.campaign, c.day""", IMP, CELLS))
def decay_rule(spark, d) -> DataFrame:
    out = hi.decayed_bank(fx.cells(spark, d), ["campaign"])
    return out.select("campaign", "day", *[r6(c) for c in hi.HALF_LIVES])


@query("build_candidates", "H4", sql("""
SELECT d.day, r.expert, r.ord, CAST(r.win AS DOUBLE) AS window_days, CAST(r.hl AS DOUBLE) AS half_life
FROM (SELECT DISTINCT day FROM imp WHERE day >= 4) d CROSS JOIN reg r""", IMP, REG))
def build_candidates(spark, d) -> DataFrame:
    """Every (prediction day, rule) pair to be fitted."""
    days = fx.eligible(sp.day_axis(fx.cells(spark, d))).select("day")
    return days.crossJoin(F.broadcast(hi.expert_registry(spark))).select(
        "day", "expert", "ord", F.col("window_days").cast("double").alias("window_days"), "half_life")


@query("effective_key", "H5", sql("""
SELECT day, expert, lo, hi, CAST(dense_rank() OVER (PARTITION BY day ORDER BY f) - 1 AS INTEGER) AS effective_id
FROM (SELECT *, min(ord) OVER (PARTITION BY day, lo, hi) AS f FROM bounds)""", IMP, REG, BOUNDS))
def effective_key(spark, d) -> DataFrame:
    return hi.effective_experts(_bounds(spark, d)).select("day", "expert", "lo", "hi", "effective_id")


_OUT = ", ".join(f"round({e}, 6) AS {e}" for e in EXPERTS)


@query("rate_expert", "H9", sql(f"SELECT row_id, day, click, {_OUT} FROM bank", *BASE))
def rate_expert(spark, d) -> DataFrame:
    return fx.bank_rows(spark, d).select("row_id", "day", "click", *[r6(e) for e in EXPERTS])


@query("rate_expert_matured", "H9", sql(f"""
SELECT campaign, day, {_OUT} FROM mrates WHERE day >= 4""", IMP, CELLS, rates(True, "mrates")))
def rate_expert_matured(spark, d) -> DataFrame:
    """The same experts on labels that had arrived by midnight."""
    return fx.wide_cells(spark, d, matured=True).select("campaign", "day", *[r6(e) for e in EXPERTS])


@query("uniform5", "H11", sql("SELECT row_id, day, round(uniform5, 6) AS p FROM bank", *BASE))
def uniform5(spark, d) -> DataFrame:
    rows = hi.uniform_mix(fx.bank_rows(spark, d), hi.WINDOW_ORDER)
    return rows.select("row_id", "day", r6("uniform5", "p"))


ETA_GRID = [0.0, 0.1, 0.3, 1.0, 3.0]
_ETAS = ", ".join(f"({e}::DOUBLE)" for e in ETA_GRID)


@query("diff_forgetting_grid", "H10", sql(f"""
SELECT t, eta, round(loss, 6) AS loss FROM (
  SELECT f.t, f.eta, sum(v.k * -ln(f.rate) + (v.n - v.k) * -ln(1 - f.rate)) / sum(v.n) AS loss
  FROM fit f JOIN cells v ON v.campaign = f.campaign AND v.day >= f.t - 3 AND v.day < f.t GROUP BY f.t, f.eta)""",
    IMP, CELLS, f"""fit AS (
  SELECT d.t, e.eta, c.campaign,
    (coalesce(sum(h.k * exp(-e.eta * (d.t - h.day))), 0) + 0.8) / (coalesce(sum(h.n * exp(-e.eta * (d.t - h.day))), 0) + 2) AS rate
  FROM (SELECT DISTINCT day AS t FROM imp WHERE day >= 6) d CROSS JOIN (VALUES {_ETAS}) e(eta)
  CROSS JOIN (SELECT DISTINCT campaign FROM imp) c
  LEFT JOIN cells h ON h.campaign = c.campaign AND h.day < d.t - 3 GROUP BY ALL)"""))
def diff_forgetting_grid(spark, d) -> DataFrame:
    """Held-out loss of each forgetting rate on the last three history days, for every prediction day."""
    cells = fx.cells(spark, d)
    days = sp.day_axis(fx.cells(spark, d)).filter(F.col("day") >= 6)
    etas = sp.grid(spark, eta=ETA_GRID).select("eta")
    targets = days.crossJoin(F.broadcast(etas)).select(
        F.col("day").alias("t"), (F.col("day") - 3).alias("upto"), "eta")
    out = hi.forgetting_losses(cells, ["campaign"], targets)
    return out.select("t", "eta", r6("loss"))


@query("diff_forgetting", "H10")
def diff_forgetting(spark, d) -> DataFrame:
    """Learned forgetting rate, its half-life, and the loss of the refit on the prediction day."""
    cells = settle(fx.cells(spark, d))
    days = [r["day"] for r in cells.select("day").distinct().filter(F.col("day") >= 6).collect()]
    learned = hi.learn_forgetting(cells, ["campaign"], sorted(days))
    rates_ = hi.forgetting_rates(cells, ["campaign"], learned)
    today = cells.withColumnRenamed("day", "t").join(rates_, ["t", "campaign"], "left")
    p = F.coalesce(F.col("rate"), F.lit(hi.PRIOR_RATE))
    scored = today.filter(F.col("t") >= 6).groupBy("t").agg(
        (F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), p)) / F.sum("n")).alias("loss"))
    return learned.join(scored, "t").select("t", r6("eta"), r6("half_life"), r6("loss"))


@query("validation_selected", "M1", sql("""
SELECT expert, round(dev_loss, 6) AS dev_loss, round(t.loss, 6) AS test_loss FROM (
  SELECT expert, ord, sum(loss * n) / sum(n) AS dev_loss FROM dl WHERE day < (SELECT test_from FROM day_bounds) GROUP BY expert, ord
  ORDER BY round(sum(loss * n) / sum(n), 10), ord LIMIT 1)
JOIN (SELECT expert, sum(loss * n) / sum(n) AS loss FROM dl WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY expert) t USING (expert)""", *LONG))
def validation_selected(spark, d) -> DataFrame:
    """Fixed window with the lowest dev loss, and what it costs on the locked test days."""
    losses = fx.day_losses(fx.expert_tally(spark, d))
    roles = sp.dev_test(sp.day_axis(fx.cells(spark, d)), fx.WARMUP_DAYS, fx.TEST_FRAC)
    chosen = mx.select_on(roles.filter("role = 'dev'").select("day"), losses, [])
    test = losses.join(roles.filter("role = 'test'"), "day").groupBy("expert").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("test_loss"))
    return chosen.join(test, "expert").select("expert", r6("loss", "dev_loss"), r6("test_loss"))


@query("window_report", "H1,M1,W1,A2", sql("""
SELECT d.day, d.expert, d.n, round(d.loss, 6) AS loss, CASE WHEN d.day >= (SELECT test_from FROM day_bounds) THEN 'test' ELSE 'dev' END AS role,
       d.expert = (SELECT expert FROM dl WHERE day < (SELECT test_from FROM day_bounds) GROUP BY expert, ord
                   ORDER BY round(sum(loss * n) / sum(n), 10), ord LIMIT 1) AS dev_selected,
       row_number() OVER (PARTITION BY d.day ORDER BY d.rl, d.ord) = 1 AS hindsight_best
FROM dl d""", *LONG))
def window_report(spark, d) -> DataFrame:
    """Daily loss of each history window, the dev-selected window and the hindsight best window."""
    losses = fx.day_losses(fx.expert_tally(spark, d))
    roles = sp.dev_test(sp.day_axis(fx.cells(spark, d)), fx.WARMUP_DAYS, fx.TEST_FRAC)
    chosen = mx.select_on(roles.filter("role = 'dev'").select("day"), losses, []).select(
        F.col("expert").alias("_chosen"))
    best = dg.best_per(losses, ["day"]).select("day", F.col("expert").alias("_best"))
    return (losses.join(roles, "day").join(best, "day").crossJoin(F.broadcast(chosen))
            .select("day", "expert", "n", r6("loss"), "role", (F.col("expert") == F.col("_chosen")).alias("dev_selected"),
                    (F.col("expert") == F.col("_best")).alias("hindsight_best")))
