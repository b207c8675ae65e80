"""Queries: chronological splits, hindsight diagnostics and hyper-parameter selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import calibrate as ca
from tidelog.operators import diagnostics as dg
from tidelog.operators import history as hi
from tidelog.operators import metrics as me
from tidelog.operators import mixing as mx
from tidelog.operators import selection as se
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans import mixing_queries as mq
from tidelog.plans import within_queries as wq
from tidelog.plans.history_queries import BOUNDS, REG, _bounds
from tidelog.plans.metric_queries import INNER
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BANKL, BASE, EXPERTS, IMP, LONG, METH, SEEDED, ll, sg, sql


def _days(spark, d) -> DataFrame:
    return sp.day_axis(fx.cells(spark, d))


def _origins(spark, d, days: DataFrame) -> DataFrame:
    return days.filter(F.col("day") >= fx.first_test(spark, d))


def _pairs(spark, d) -> DataFrame:
    days = _days(spark, d)
    return sp.inner_days(days, _origins(spark, d, days), 3, fx.FIRST_ELIGIBLE).select("origin", "inner_day")


# ---- splits -------------------------------------------------------------------------------------

@query("compute_splits", "O1", sql("""
SELECT CAST(day AS INTEGER) AS day, CASE WHEN day >= (SELECT test_from FROM day_bounds) THEN 'test' ELSE 'dev' END AS role
FROM (SELECT unnest(range(4, last_day + 1)) AS day FROM day_bounds)""", IMP))
def compute_splits(spark, d) -> DataFrame:
    return sp.dev_test(_days(spark, d), fx.WARMUP_DAYS, fx.TEST_FRAC)


@query("make_split", "O2", sql("""
SELECT DISTINCT day, CASE WHEN day < a THEN 'train' WHEN day < a + b THEN 'dev' ELSE 'test' END AS role FROM imp,
  (SELECT least(greatest(4, round_even(n * 60 / 116.0, 0)), n - greatest(1, round_even(n * 21 / 116.0, 0)) - 1) AS a,
          greatest(1, round_even(n * 21 / 116.0, 0)) AS b FROM (SELECT max(day) + 1 AS n FROM imp))""", IMP))
def make_split(spark, d) -> DataFrame:
    return sp.three_way(_days(spark, d), warmup=4)


@query("inner_days", "O3", sql("SELECT origin, inner_day, CAST(recency AS INTEGER) AS recency FROM inner3", IMP, INNER))
def inner_days(spark, d) -> DataFrame:
    days = _days(spark, d)
    return sp.inner_days(days, _origins(spark, d, days), 3, fx.FIRST_ELIGIBLE)


@query("adapter_split", "O4", sql("""
SELECT day, CASE WHEN r <= greatest(1, floor(n * 0.7)) THEN 'fit' ELSE 'hold' END AS by_share,
       CASE WHEN r < n THEN 'fit' ELSE 'hold' END AS by_last
FROM (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM imp WHERE day >= 4))""",
    IMP))
def adapter_split(spark, d) -> DataFrame:
    days = fx.eligible(_days(spark, d)).select("day")
    a = sp.holdout(days, 0.7).withColumnRenamed("part", "by_share")
    return a.join(sp.holdout(days).withColumnRenamed("part", "by_last"), "day")


# ---- rolling origin over mixture configurations ---------------------------------------------------

def mixture_daily(spark, d) -> DataFrame:
    """Daily loss sums of every mixture configuration, split by label maturity."""
    weights = mq.hedge_weights(spark, d)
    log = fx.imp(spark, d).withColumn("early", ta.matured_by_midnight(F.col("sec")))
    mixed = mx.mix(fx.with_rates(hi.cell_counts(log, ["campaign", "early"])), weights, EXPERTS, "p")
    return mixed.groupBy("eta", "half_life", "day", "early").agg(
        F.sum("n").alias("n"), F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))).alias("s"))


HMIX = f"""hwf AS (SELECT g.day, g.eta, g.half_life, {', '.join(f"coalesce(max(w) FILTER (expert = '{e}'), 0.2) AS w_{e}" for e in EXPERTS)}
  FROM (SELECT DISTINCT day, eta, half_life FROM hl) g LEFT JOIN hw USING (day, eta, half_life) GROUP BY g.day, g.eta, g.half_life),
hp AS (SELECT w.eta, w.half_life, b.day, b.sec, b.click, {' + '.join(f'w.w_{e} * b.{e}' for e in EXPERTS)} AS p
       FROM hwf w JOIN bank b ON b.day = w.day)"""
MIXTURE = [*BASE, BANKL, mq.DL6, mq.HEDGE, HMIX]
INNERL = f"""il AS (SELECT t.origin, h.eta, h.half_life, avg({ll('click', 'p')}) AS loss FROM inner3 t JOIN hp h ON h.day = t.inner_day
  WHERE CAST(h.day AS BIGINT) * 86400 + h.sec + 1800 <= CAST(t.origin AS BIGINT) * 86400 GROUP BY t.origin, h.eta, h.half_life)"""


def _inner_grid(spark, d) -> tuple[DataFrame, DataFrame]:
    daily = mixture_daily(spark, d)
    return daily, se.inner_losses(_pairs(spark, d), daily, ["eta", "half_life"])


@query("rolling_origin", "O5", sql(f"""
SELECT i.origin, i.eta, i.half_life, round(i.loss, 6) AS inner_loss, round(s.loss, 6) AS origin_loss
FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY round(loss, 10), eta, half_life) AS r FROM il) i
JOIN (SELECT day, eta, half_life, avg({ll('click', 'p')}) AS loss FROM hp GROUP BY ALL) s
  ON s.day = i.origin AND s.eta = i.eta AND s.half_life = i.half_life WHERE i.r = 1""", *MIXTURE, INNER, INNERL))
def rolling_origin(spark, d) -> DataFrame:
    """Per origin: choose the configuration on matured inner days, then score the origin day once."""
    daily, inner = _inner_grid(spark, d)
    chosen = se.lowest(inner, ["origin"], "loss", ["eta", "half_life"]).withColumnRenamed("loss", "inner_loss")
    today = daily.groupBy("eta", "half_life", F.col("day").alias("origin")).agg(
        (F.sum("s") / F.sum("n")).alias("origin_loss"))
    return chosen.join(today, ["origin", "eta", "half_life"]).select(
        "origin", "eta", "half_life", r6("inner_loss"), r6("origin_loss"))


# ---- hindsight diagnostics ------------------------------------------------------------------------

def _losses(spark, d) -> DataFrame:
    return fx.day_losses(fx.expert_tally(spark, d))


@query("hindsight_best_window", "W1", sql("""
SELECT day, expert, round(loss, 6) AS loss FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY rl, ord) AS r FROM dl WHERE day >= (SELECT test_from FROM day_bounds)) WHERE r = 1""", *LONG))
def hindsight_best_window(spark, d) -> DataFrame:
    best = dg.best_per(_losses(spark, d).filter(F.col("day") >= fx.first_test(spark, d)), ["day"])
    return best.select("day", "expert", r6("loss"))


NOMINAL = "nom AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {v})" for k, v in hi.NOMINAL_DAYS.items()) + ") n(expert, days))"


@query("oracle_horizon", "W2", sql(f"""
SELECT day, grp, expert, nominal, round(loss, 6) AS loss, persistence FROM (
  SELECT g.day, g.grp, g.expert, n.days AS nominal, g.loss, CASE WHEN u.hl < u.lo THEN 'high' ELSE 'low' END AS persistence,
         row_number() OVER (PARTITION BY g.day, g.grp ORDER BY round(g.loss, 10), g.ord) AS r
  FROM (SELECT day, coalesce(grp, 'overall') AS grp, expert, ord, avg({ll('click', 'p')}) AS loss FROM bankl
        GROUP BY GROUPING SETS ((day, grp, expert, ord), (day, expert, ord))) g JOIN nom n ON n.expert = g.expert
  JOIN (SELECT day, round(max(log_loss) FILTER (method = 'uniform5'), 10) AS hl, round(max(log_loss) FILTER (method = 'roll7'), 10) AS lo
        FROM pd GROUP BY day) u ON u.day = g.day) WHERE r = 1""", *METH, BANKL, NOMINAL))
def oracle_horizon(spark, d) -> DataFrame:
    """Best window of each day overall and per group, and which of two smoothing levels would have won."""
    t = fx.method_tally(spark, d, grp=F.col("grp"))
    losses = me.with_overall(t.filter(F.col("method") != "uniform5"), ["day", "method", "ord"], "grp")
    best = dg.best_per(losses, ["day", "grp"], name="method", loss="log_loss")
    two = me.mean_losses(t.filter(F.col("method").isin("uniform5", "roll7")), ["day", "method"])
    two = two.groupBy("day").pivot("method", ["uniform5", "roll7"]).agg(F.round(F.first("log_loss"), 10))
    return best.join(two, "day").select(
        "day", "grp", F.col("method").alias("expert"), dg.nominal_days(F.col("method")).alias("nominal"), r6("log_loss", "loss"),
        F.when(F.col("uniform5") < F.col("roll7"), "high").otherwise("low").alias("persistence"))


@query("best_fixed_horizon", "W3", sql("""
SELECT expert, round(avg(loss), 6) AS loss FROM dl WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY expert, ord
ORDER BY round(avg(loss), 10), ord LIMIT 1""", *LONG))
def best_fixed_horizon(spark, d) -> DataFrame:
    mean = _losses(spark, d).filter(F.col("day") >= fx.first_test(spark, d)).groupBy("expert", "ord").agg(F.avg("loss").alias("loss"))
    return dg.best_per(mean, []).select("expert", r6("loss"))


_MOVE = " + ".join(f"abs(w_{e} - lag(w_{e}) OVER (ORDER BY day))" for e in EXPERTS)
_HEFF = " + ".join(f"w_{e} * {v}" for e, v in hi.NOMINAL_DAYS.items())


@query("gate_dynamics", "W4", sql(f"""
SELECT day, round({_MOVE}, 6) AS move, round({_HEFF}, 6) AS horizon FROM wt""", *LONG, *mq.SOFT_PATH, recursive=True))
def gate_dynamics(spark, d) -> DataFrame:
    weights = mx.ema_of_softmax(_losses(spark, d), len(EXPERTS), 0.75)
    out = dg.weight_movement(mx.weights_long(weights, EXPERTS, ["day"]))
    return out.select("day", r6("move"), r6("horizon"))


SHIFTS, HORIZON, TOL, PATIENCE = [10, 18], 8, 0.002, 3
EXCESS = """x AS (SELECT method, day, log_loss - (SELECT min(loss) FROM dl WHERE dl.day = pd.day) AS excess FROM pd)"""


@query("adaptation_metrics", "W5", sql(f"""
SELECT o.method, round(o.me, 6) AS mean_excess, round(o.mx, 6) AS max_excess, round(s.peak, 6) AS peak,
       round(s.regret, 6) AS regret, round(s.recovery, 6) AS recovery
FROM (SELECT method, avg(excess) AS me, max(excess) AS mx FROM x GROUP BY method) o
JOIN (SELECT method, avg(peak) AS peak, avg(regret) AS regret, avg(rec) AS recovery FROM (
  SELECT x.method, s.sd, max(x.excess) AS peak, sum(x.excess) AS regret, min(CASE WHEN (SELECT count(*) FROM x y WHERE y.method = x.method
    AND y.day BETWEEN x.day AND x.day + {PATIENCE - 1} AND y.day <= s.sd + {HORIZON} AND y.excess <= {TOL}) = {PATIENCE} THEN x.day - s.sd END) AS rec
  FROM x JOIN (VALUES (10), (18)) s(sd) ON x.day BETWEEN s.sd AND s.sd + {HORIZON} GROUP BY x.method, s.sd) GROUP BY method) s
  ON s.method = o.method""", *METH, BANKL, LONG[-1], EXCESS))
def adaptation_metrics(spark, d) -> DataFrame:
    per = fx.per_day(spark, d)
    best = per.filter(F.col("method").isin(EXPERTS)).groupBy("day").agg(F.min("log_loss").alias("_best"))
    excess = per.join(best, "day").select("method", "day", (F.col("log_loss") - F.col("_best")).alias("excess"))
    out = dg.adaptation(excess, SHIFTS, HORIZON, TOL, PATIENCE)
    return out.select("method", r6("mean_excess"), r6("max_excess"), r6("peak"), r6("regret"), r6("recovery"))


RES = """res AS (SELECT day, sec // 3600 AS block, avg(click - expanding) AS r FROM bank GROUP BY day, sec // 3600),
seq AS (SELECT *, sign(r) AS s, lag(r) OVER w AS pr, lag(sign(r)) OVER w AS ps, row_number() OVER w AS i FROM res
        WINDOW w AS (PARTITION BY day ORDER BY block)),
run AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> s OR s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY block) AS g FROM seq)"""


@query("residual_runs", "W6", sql("""
SELECT a.day, a.longest AS longest_run, b.n AS n_blocks, round(CASE WHEN b.n > 2 THEN b.c END, 6) AS autocorr
FROM (SELECT day, max(c) AS longest FROM (SELECT day, g, count(*) AS c FROM run GROUP BY day, g) GROUP BY day) a
JOIN (SELECT day, count(*) AS n, corr(r, pr) AS c FROM seq GROUP BY day) b ON b.day = a.day""", *BASE, RES))
def residual_runs(spark, d) -> DataFrame:
    t = fx.method_tally(spark, d, block=ta.block_of(F.col("sec"), 3600)).filter(F.col("method") == hi.LONG)
    blocks = t.groupBy("day", "block").agg(
        (F.sum(F.col("clicks") - F.col("n") * F.col("p")) / F.sum("n")).alias("residual"))
    return dg.residual_runs(blocks).select("day", "longest_run", "n_blocks", r6("autocorr"))


GAIN = f"""gain AS (SELECT o.day, o.b, avg({ll('q.click', 'q.q')}) AS l_long, avg({ll('q.click', sg('q.z + o.b'))}) AS l_oracle
  FROM ob o JOIN bq q ON q.day = o.day GROUP BY o.day, o.b)"""


@query("daily_oracle_gain", "W7", sql("""
SELECT day, round(l_long, 6) AS l_long, round(l_oracle, 6) AS l_oracle, round(l_long - l_oracle, 6) AS gain,
       round((l_long - l_oracle) / l_long, 6) AS rel_gain FROM gain""", *BASE, *wq.ORACLE_B, GAIN, recursive=True))
def daily_oracle_gain(spark, d) -> DataFrame:
    out = wq.oracle_losses(spark, d)
    gain = F.col("l_long") - F.col("l_oracle")
    return out.select("day", r6("l_long"), r6("l_oracle"), r6(gain, "gain"), r6(gain / F.col("l_long"), "rel_gain"))


@query("regret_captured_gain", "W8", sql(f"""
SELECT g.day, round(m.l - g.l_oracle, 6) AS regret, g.l_long - g.l_oracle < 1e-4 AS negligible,
       round(CASE WHEN g.l_long - g.l_oracle >= 1e-4 THEN (g.l_long - m.l) / (g.l_long - g.l_oracle) END, 4) AS captured
FROM gain g JOIN (SELECT b.day, avg({ll('b.click', sg('p.a * b.z + p.b'))}) AS l FROM bq b JOIN path p ON p.day = b.day AND p.block = b.block
  WHERE p.cfg = 'intercept' GROUP BY b.day) m ON m.day = g.day""",
    *BASE, *wq.ORACLE_B, GAIN, *wq.ops_ctes(wq.OPS_CONFIGS), recursive=True))
def regret_captured_gain(spark, d) -> DataFrame:
    st = wq.stats(spark, d)
    method = ca.day_losses(ca.scored_blocks(st, ca.ops_path(st, wq.OPS_CONFIGS[:1])), ["cfg"])
    losses = wq.oracle_losses(spark, d).join(method.select("day", F.col("loss").alias("l_method")), "day")
    return dg.captured_gain(losses).select("day", r6("regret"), "negligible", F.round("captured", 4).alias("captured"))


PAIR = """pr AS (SELECT a.day, a.n, a.log_loss AS loss_a, b.log_loss AS loss_b, a.log_loss - b.log_loss AS delta
  FROM pd a JOIN pd b ON b.day = a.day AND b.method = 'expanding' WHERE a.method = 'roll7')"""


def _pair(spark, d) -> DataFrame:
    return dg.paired(fx.per_day(spark, d), "roll7", "expanding")


@query("paired_day_diffs", "W9", sql("""
SELECT day, n, round(loss_a, 6) AS loss_a, round(loss_b, 6) AS loss_b, round(delta, 6) AS delta FROM pr""", *METH, PAIR))
def paired_day_diffs(spark, d) -> DataFrame:
    return _pair(spark, d).select("day", "n", r6("loss_a"), r6("loss_b"), r6("delta"))


@query("days_won", "W10", sql("""
SELECT count(*) AS days, count(*) FILTER (delta < -1e-9) AS won, count(*) FILTER (abs(delta) <= 1e-9) AS tied,
       round(avg(CASE WHEN delta < -1e-9 THEN 1.0 ELSE 0.0 END), 6) AS share FROM pr""", *METH, PAIR))
def days_won(spark, d) -> DataFrame:
    v = F.col("delta")
    return _pair(spark, d).agg(F.count("*").alias("days"), F.count_if(v < -1e-9).alias("won"),
                               F.count_if(F.abs(v) <= 1e-9).alias("tied"),
                               r6(F.avg(F.when(v < -1e-9, 1.0).otherwise(0.0)), "share"))


@query("weight_trace", "W11", sql("""
SELECT day, eta, half_life, top, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY day, eta, half_life ORDER BY round(w, 9) DESC, ord) AS r,
  expert AS top FROM (SELECT h.*, l.ord FROM hw h JOIN (SELECT DISTINCT expert, ord FROM dl6) l USING (expert))) WHERE r = 1
UNION ALL SELECT DISTINCT day, eta, half_life, 'roll1', 0.2 FROM hl WHERE day = 4""", *BASE, BANKL, mq.DL6, mq.HEDGE))
def weight_trace(spark, d) -> DataFrame:
    """Leading expert of each day under several learning rates."""
    rows = mx.weights_long(mq.hedge_weights(spark, d), EXPERTS, ["day", "eta", "half_life"])
    lead = F.max_by(F.struct("expert", "w"), F.struct(F.round("w", 9), -F.col("ord"))).alias("t")
    return rows.groupBy("day", "eta", "half_life").agg(lead).select(
        "day", "eta", "half_life", F.col("t.expert").alias("top"), r6(F.col("t.w"), "w"))


@query("seed_spread", "W12", sql("""
SELECT method, day, round(max(log_loss) - min(log_loss), 6) AS spread FROM spd GROUP BY method, day""", *SEEDED))
def seed_spread(spark, d) -> DataFrame:
    return fx.per_day_seed(spark, d).groupBy("method", "day").agg(
        r6(F.max("log_loss") - F.min("log_loss"), "spread"))


@query("cumulative_excess", "W13", sql("""
SELECT day, round(sum(delta) OVER (ORDER BY day), 6) AS cumulative FROM pr""", *METH, PAIR))
def cumulative_excess(spark, d) -> DataFrame:
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    return _pair(spark, d).select("day", r6(F.sum("delta").over(w), "cumulative"))


_FSL = " UNION ALL ".join(f"SELECT day, '{e}' AS expert, w_{e} AS w FROM wt" for e in EXPERTS)


@query("effective_weights", "W15", sql(f"""
SELECT w.day, a.effective_id, string_agg(a.expert, '+' ORDER BY a.ord) AS members, round(sum(w.w), 6) AS w
FROM ({_FSL}) w JOIN (SELECT *, CAST(dense_rank() OVER (PARTITION BY day ORDER BY f) - 1 AS INTEGER) AS effective_id
  FROM (SELECT *, min(ord) OVER (PARTITION BY day, lo, hi) AS f FROM bounds)) a ON a.day = w.day AND a.expert = w.expert
GROUP BY w.day, a.effective_id""", *LONG, *mq.FS_PATH, REG, BOUNDS, recursive=True))
def effective_weights(spark, d) -> DataFrame:
    """Weight mass on each distinct training window of the day."""
    weights = mx.weights_long(mx.fixed_share(_losses(spark, d), len(EXPERTS)), EXPERTS, ["day"])
    alias = hi.effective_experts(_bounds(spark, d)).select("day", "expert", "effective_id")
    members = F.array_join(F.sort_array(F.collect_list(F.struct("ord", "expert"))).getField("expert"), "+")
    return weights.join(alias, ["day", "expert"]).groupBy("day", "effective_id").agg(
        members.alias("members"), r6(F.sum("w"), "w"))


@query("oracle_persistence_share", "W16", sql("""
SELECT count(*) AS days, round(avg(CASE WHEN round(h, 10) < round(l, 10) THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM (
  SELECT day, max(log_loss) FILTER (method = 'uniform5') AS h, max(log_loss) FILTER (method = 'roll7') AS l
  FROM pd WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY day)""", *METH))
def oracle_persistence_share(spark, d) -> DataFrame:
    wide = fx.per_day(spark, d).filter(F.col("day") >= fx.first_test(spark, d)).groupBy("day").pivot(
        "method", ["uniform5", "roll7"]).agg(F.round(F.first("log_loss"), 10))
    return wide.agg(F.count("*").alias("days"),
                    r6(F.avg(F.when(F.col("uniform5") < F.col("roll7"), 1.0).otherwise(0.0)), "high_share"))


# ---- selection ------------------------------------------------------------------------------------

@query("full_grid", "G1", sql("""
SELECT o.origin, CAST(e.i * 3 + h.i AS INTEGER) AS cfg, e.eta, h.half_life FROM origins o
CROSS JOIN (VALUES (0, 20.0::DOUBLE), (1, 60.0), (2, 200.0)) e(i, eta) CROSS JOIN (VALUES (0, 3.0::DOUBLE), (1, 5.0), (2, 10.0)) h(i, half_life)""",
    IMP, INNER))
def full_grid(spark, d) -> DataFrame:
    """Every configuration for every origin."""
    g = sp.grid(spark, eta=[20.0, 60.0, 200.0], half_life=[3.0, 5.0, 10.0])
    return _origins(spark, d, _days(spark, d)).select(F.col("day").alias("origin")).crossJoin(F.broadcast(g))


@query("mixture_grid", "G2", sql(f"""
SELECT eta, half_life, round(l, 6) AS dev_loss, row_number() OVER (ORDER BY round(l, 10), eta, half_life) = 1 AS selected
FROM (SELECT eta, half_life, avg({ll('click', 'p')}) AS l FROM hp WHERE day < (SELECT test_from FROM day_bounds) GROUP BY eta, half_life)""", *MIXTURE))
def mixture_grid(spark, d) -> DataFrame:
    dev = mixture_daily(spark, d).filter(F.col("day") < fx.first_test(spark, d)).groupBy("eta", "half_life").agg(
        (F.sum("s") / F.sum("n")).alias("dev_loss"))
    best = se.lowest(dev.withColumn("_k", F.lit(1)), ["_k"], "dev_loss", ["eta", "half_life"])
    keyed = best.select("eta", "half_life", F.lit(True).alias("_s"))
    return dev.join(keyed, ["eta", "half_life"], "left").select(
        "eta", "half_life", r6("dev_loss"), F.coalesce("_s", F.lit(False)).alias("selected"))


GRID_OPS = [ca.OpsConfig(f"e{e}_r{r}_{'s' if s else 'c'}", radius=r, eta0=e, decay_steps=s)
            for e in (0.05, 0.2) for r in (0.5, 1.0) for s in (True, False)]


@query("calib_grid", "G3", sql(f"""
SELECT cfg, round(l, 6) AS loss, round(worst, 6) AS worst, CAST(steps AS BIGINT) AS updates,
       row_number() OVER (ORDER BY round(l, 6), steps, radius, round(worst, 8), cfg) AS place
FROM (SELECT cfg, radius, sum(l * n) / sum(n) AS l, max(l) AS worst, sum(steps) AS steps FROM (
  SELECT p.cfg, c.radius, b.day, count(*) AS n, avg({ll('b.click', sg('p.a * b.z + p.b'))}) AS l, max(p.step) AS steps
  FROM bq b JOIN path p ON p.day = b.day AND p.block = b.block JOIN cfgs c ON c.cfg = p.cfg WHERE b.day < (SELECT test_from FROM day_bounds) GROUP BY p.cfg, c.radius, b.day)
  GROUP BY cfg, radius)""", *BASE, wq.q_cte(), *wq.ops_ctes(GRID_OPS), recursive=True))
def calib_grid(spark, d) -> DataFrame:
    """Calibration grid on the dev days, ordered by rounded loss, updates, radius, worst day."""
    st = wq.stats(spark, d).filter(F.col("day") < fx.first_test(spark, d))
    path = ca.ops_path(st, GRID_OPS)
    days = ca.day_losses(ca.scored_blocks(st, path), ["cfg"])
    steps = path.groupBy("cfg", "day").agg(F.max("step").alias("steps"))
    radius = spark.createDataFrame([(c.name, c.radius) for c in GRID_OPS], "cfg string, radius double")
    table = days.join(steps, ["cfg", "day"]).groupBy("cfg").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.max("loss").alias("worst"),
        F.sum("steps").alias("updates")).join(F.broadcast(radius), "cfg")
    order = Window.orderBy(F.round("loss", 6), "updates", "radius", F.round("worst", 8), "cfg")  # one row per configuration
    return table.select("cfg", r6("loss"), r6("worst"), "updates", F.row_number().over(order).cast("long").alias("place"))


DEVSEED = """ds AS (SELECT seed, method, ord, sum(log_loss * n) / sum(n) AS loss, max(log_loss) AS worst FROM spd WHERE day < (SELECT test_from FROM day_bounds) GROUP BY seed, method, ord),
mm AS (SELECT method, ord, round(avg(loss), 10) AS ml, round(avg(worst), 10) AS mw FROM ds GROUP BY method, ord)"""


@query("select_mean_across_seeds", "G4", sql("""
SELECT method, round(ml, 6) AS mean_loss, round(mw, 6) AS mean_worst,
  row_number() OVER (ORDER BY ml - (SELECT min(ml) FROM mm) < 1e-6 DESC, mw, ord) = 1 AS selected FROM mm""", *SEEDED, DEVSEED))
def select_mean_across_seeds(spark, d) -> DataFrame:
    dev = fx.per_day_seed(spark, d).filter(F.col("day") < fx.first_test(spark, d)).groupBy("seed", "method", "ord").agg(
        (F.sum(F.col("log_loss") * F.col("n")) / F.sum("n")).alias("loss"), F.max("log_loss").alias("worst"))
    out = se.select_across_seeds(dev, ["method"], "ord")
    return out.select("method", r6("mean_loss"), r6("mean_worst"), "selected")


@query("one_se_rule", "G5", sql("""
SELECT origin, expert, round(score, 6) AS score, round(lim, 6) AS limit_loss FROM (
  SELECT s.*, b.lim, row_number() OVER (PARTITION BY s.origin ORDER BY s.ord) AS r FROM sc s
  JOIN (SELECT origin, score + se AS lim FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY score, ord) AS r FROM sc) WHERE r = 1) b
    ON b.origin = s.origin WHERE s.score <= b.lim) WHERE r = 1""", *LONG, INNER, """sc AS (
  SELECT t.origin, d.expert, d.ord, round(avg(d.loss), 10) AS score, coalesce(round(stddev_samp(d.loss) / sqrt(count(*)), 10), 0) AS se
  FROM inner3 t JOIN dl d ON d.day = t.inner_day GROUP BY t.origin, d.expert, d.ord)"""))
def one_se_rule(spark, d) -> DataFrame:
    """Shortest window within one standard error of the best, per origin."""
    folds = _pairs(spark, d).join(_losses(spark, d), F.col("inner_day") == F.col("day"))
    out = se.one_se(folds, ["origin"], "expert", "ord")
    return out.select("origin", "expert", r6("score"), r6("_limit", "limit_loss"))


FLOOR = 2e-4
GATE = """gt AS (SELECT method, ord, sum(log_loss * n) / sum(n) AS l, max(log_loss) AS w,
  CASE WHEN count(*) > 1 THEN stddev_samp(log_loss) / sqrt(count(*)) ELSE 0 END AS se FROM pd WHERE day < (SELECT test_from FROM day_bounds) GROUP BY method, ord),
ge AS (SELECT g.method, g.ord, g.l, g.se, g.l < b.l - 2e-4 AS beats_long, g.l < s.l AS beats_short, g.w <= b.w AS safe FROM gt g
  JOIN gt b ON b.method = 'expanding' JOIN gt s ON s.method = 'roll1')"""


def _gated(spark, d) -> DataFrame:
    dev = fx.per_day(spark, d).filter(F.col("day") < fx.first_test(spark, d)).groupBy("method", "ord").agg(
        (F.sum(F.col("log_loss") * F.col("n")) / F.sum("n")).alias("loss"), F.max("log_loss").alias("worst"),
        F.when(F.count("*") > 1, F.stddev_samp("log_loss") / F.sqrt(F.count("*"))).otherwise(0.0).alias("se"))
    ref = dev.agg(*[F.max(F.when(F.col("method") == m, F.col(c))).alias(a) for m, c, a in
                    (("expanding", "loss", "_ll"), ("roll1", "loss", "_sl"), ("expanding", "worst", "_lw"))])
    return se.gates(dev.crossJoin(F.broadcast(ref)), {
        "beats_long": F.col("loss") < F.col("_ll") - FLOOR, "beats_short": F.col("loss") < F.col("_sl"),
        "safe": F.col("worst") <= F.col("_lw")})


@query("gated_eligibility", "G6", sql("""
SELECT method, round(l, 6) AS loss, beats_long, beats_short, safe, beats_long AND beats_short AND safe AS eligible FROM ge""", *METH, GATE))
def gated_eligibility(spark, d) -> DataFrame:
    return _gated(spark, d).select("method", r6("loss"), "beats_long", "beats_short", "safe", "eligible")


@query("locked_test_gate", "G9", sql(f"""
SELECT p.method, p.day, round(p.log_loss, 6) AS log_loss, e.method IS NOT NULL AS open,
       CASE WHEN e.method IS NOT NULL THEN abs(g.gain) >= {FLOOR} END AS material
FROM pd p LEFT JOIN win e ON e.method = p.method LEFT JOIN gain g ON g.method = p.method
WHERE p.day >= (SELECT test_from FROM day_bounds) AND (e.method IS NOT NULL OR p.method = 'expanding')""", *METH, GATE,
    "el AS (SELECT * FROM ge WHERE beats_long AND beats_short AND safe)",
    """win AS (SELECT method FROM el WHERE round(l, 10) <= (SELECT round(l + se, 10) FROM el ORDER BY round(l, 10), ord LIMIT 1)
         ORDER BY ord LIMIT 1)""",
    """gain AS (SELECT a.method, avg(a.log_loss - b.log_loss) AS gain FROM pd a JOIN pd b ON b.day = a.day AND b.method = 'expanding'
         WHERE a.day >= (SELECT test_from FROM day_bounds) GROUP BY a.method)"""))
def locked_test_gate(spark, d) -> DataFrame:
    """Test days of the simplest method within one standard error of the best that clears every gate, if one does,
    beside the long window; ``material`` tells whether its mean difference reaches the floor."""
    eligible = _gated(spark, d).filter("eligible").withColumn("_k", F.lit(1))
    best = se.lowest(eligible, ["_k"], "loss", ["ord"]).select("_k", F.round(F.col("loss") + F.col("se"), 10).alias("_limit"))
    near = eligible.join(best, "_k").filter(F.round("loss", 10) <= F.col("_limit"))
    winner = near.groupBy("_k").agg(F.min_by("method", "ord").alias("method")).select("method", F.lit(True).alias("open"))
    test = fx.per_day(spark, d).filter(F.col("day") >= fx.first_test(spark, d))
    long = test.filter(F.col("method") == hi.LONG).select("day", F.col("log_loss").alias("_long"))
    gain = test.join(long, "day").groupBy("method").agg(F.avg(F.col("log_loss") - F.col("_long")).alias("_gain"))
    shown = test.join(winner, "method", "left").join(gain, "method").filter("open OR method = 'expanding'")
    return shown.select("method", "day", r6("log_loss"), F.coalesce("open", F.lit(False)).alias("open"),
                        F.when(F.col("open"), F.abs(F.col("_gain")) >= FLOOR).alias("material"))


@query("grid_per_origin", "G8", sql("""
SELECT origin, eta, half_life, round(loss, 6) AS loss,
       row_number() OVER (PARTITION BY origin ORDER BY round(loss, 10), eta, half_life) = 1 AS selected FROM il""", *MIXTURE, INNER, INNERL))
def grid_per_origin(spark, d) -> DataFrame:
    _, inner = _inner_grid(spark, d)
    order = Window.partitionBy("origin").orderBy(F.round("loss", 10), "eta", "half_life")
    return inner.select("origin", "eta", "half_life", r6("loss"), (F.row_number().over(order) == 1).alias("selected"))


@query("origin_manifest", "G10", sql("""
SELECT t.origin, string_agg(CAST(t.inner_day AS VARCHAR), ',' ORDER BY t.inner_day) AS inner_days, any_value(c.expert) AS expert,
       (SELECT count(*) FROM imp WHERE day = t.origin) AS n
FROM inner3 t JOIN (SELECT origin, expert FROM (SELECT t.origin, d.expert, row_number() OVER (PARTITION BY t.origin
  ORDER BY round(sum(d.loss * d.n) / sum(d.n), 10), d.ord) AS r FROM inner3 t JOIN dl d ON d.day = t.inner_day
  GROUP BY t.origin, d.expert, d.ord) WHERE r = 1) c ON c.origin = t.origin GROUP BY t.origin""", *LONG, INNER))
def origin_manifest(spark, d) -> DataFrame:
    """One row per origin: the days its choice rests on, the choice, and its size."""
    pairs = _pairs(spark, d)
    listed = pairs.groupBy("origin").agg(F.array_join(F.sort_array(F.collect_list("inner_day")), ",").alias("inner_days"))
    chosen = mx.select_on(pairs.select("origin", F.col("inner_day").alias("day")), _losses(spark, d), ["origin"])
    size = _days(spark, d).select(F.col("day").alias("origin"), "n")
    return listed.join(chosen.select("origin", "expert"), "origin").join(size, "origin")


@query("noninferiority_margin", "G11", sql(f"""
SELECT round(0.1 * abs(avg({ll('b.click', sg('p.a * b.z + p.b'))}) - avg({ll('b.click', sg('b.z'))})), 8) AS margin,
       round(avg({ll('b.click', sg('p.a * b.z + p.b'))}), 6) AS l_ops, round(avg({ll('b.click', sg('b.z'))}), 6) AS l_q
FROM bq b JOIN path p ON p.day = b.day AND p.block = b.block WHERE p.cfg = 'platt' AND b.day < (SELECT test_from FROM day_bounds)""",
    *BASE, wq.q_cte(), *wq.ops_ctes(wq.OPS_CONFIGS), recursive=True))
def noninferiority_margin(spark, d) -> DataFrame:
    """A tenth of the gain of the calibrated over the frozen prediction on the dev days."""
    st = wq.stats(spark, d).filter(F.col("day") < fx.first_test(spark, d))
    ops = ca.scored_blocks(st, ca.ops_path(st, wq.OPS_CONFIGS[1:2])).agg((F.sum("s") / F.sum("n")).alias("l_ops"))
    q = st.agg((F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), sc.sigmoid(F.col("z")))) / F.sum("n")).alias("l_q"))
    return ops.crossJoin(q).select(F.round(0.1 * F.abs(F.col("l_ops") - F.col("l_q")), 8).alias("margin"),
                                   r6("l_ops"), r6("l_q"))
