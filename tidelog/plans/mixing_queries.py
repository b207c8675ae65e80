"""Queries: expert selection and mixing across days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import history as hi
from tidelog.operators import mixing as mx
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans.metric_queries import INNER
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BANKL, BASE, EXPERTS, LONG, ll, sql
from tidelog.session import literal_rows

K = len(EXPERTS)
W_COLS = [f"w_{e}" for e in EXPERTS]


def _losses(spark, d) -> DataFrame:
    return fx.day_losses(fx.expert_tally(spark, d))


def _show(weights: DataFrame, keep: list[str]) -> DataFrame:
    return weights.select(*keep, *[r6(F.col("w")[i], c) for i, c in enumerate(W_COLS)])


def _with_loss(spark, d, weights: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Weights used on each day and the loss of the mixture they give."""
    keep = keep or []
    mixed = mx.mix(fx.wide_cells(spark, d), weights, EXPERTS, "p")
    loss = F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))) / F.sum("n")
    scored = mixed.groupBy(*keep, "day").agg(loss.alias("loss"))
    return _show(weights.join(scored, [*keep, "day"]), [*keep, "day", F.round("loss", 6).alias("loss")])


DLW = """dlw AS (SELECT day, row_number() OVER (ORDER BY day) AS i, """ + ", ".join(
    f"max(loss) FILTER (expert = '{e}') AS l{i}" for i, e in enumerate(EXPERTS)) + " FROM dl GROUP BY day)"
_W = ", ".join(f"f.w{i} AS w_{e}" for i, e in enumerate(EXPERTS))
_RW = ", ".join(f"round(w_{e}, 6) AS w_{e}" for e in EXPERTS)
_MIXP = " + ".join(f"w.w_{e} * b.{e}" for e in EXPERTS)
MIXED = f"""SELECT w.day, round(avg({ll('click', _MIXP)}), 6) AS loss, {', '.join(f'round(any_value(w.w_{e}), 6) AS w_{e}' for e in EXPERTS)}
FROM wt w JOIN bank b ON b.day = w.day GROUP BY w.day"""


def _recursion(table: str, step: list[str], norm: str | None = None) -> str:
    """Recursive weight path: ``step[i]`` is the unnormalised next weight of expert i."""
    nxt = ", ".join(step)
    return f"""{table} AS (
  SELECT CAST(1 AS BIGINT) AS i, {', '.join(f'CAST(0.2 AS DOUBLE) AS w{i}' for i in range(K))}
  UNION ALL SELECT f.i + 1, {nxt} FROM {table} f JOIN dlw l ON l.i = f.i)"""


def _wt(table: str) -> str:
    return f"wt AS (SELECT l.day, {_W} FROM {table} f JOIN dlw l ON l.i = f.i)"


@query("best_fixed_inner", "M2", sql("""
SELECT origin, expert, round(l, 6) AS loss FROM (
  SELECT t.origin, d.expert, sum(d.loss * d.n) / sum(d.n) AS l,
         row_number() OVER (PARTITION BY t.origin ORDER BY round(sum(d.loss * d.n) / sum(d.n), 10), d.ord) AS r
  FROM inner3 t JOIN dl d ON d.day = t.inner_day GROUP BY t.origin, d.expert, d.ord) WHERE r = 1""", *LONG, INNER))
def best_fixed_inner(spark, d) -> DataFrame:
    days = sp.day_axis(fx.cells(spark, d))
    inner = sp.inner_days(days, days.filter(F.col("day") >= fx.first_test(spark, d)), 3, fx.FIRST_ELIGIBLE)
    out = mx.select_on(inner.select("origin", F.col("inner_day").alias("day")), _losses(spark, d), ["origin"])
    return out.select("origin", "expert", r6("loss"))


def _tournament_sql(stats: str, order: list[str], bound: str | None, psi: str, min_history: int,
                    fallback: str | None, extra: list[str]) -> str:
    """``psi`` uses size, k, sd, M and days."""
    ctes = [*extra, f"st AS ({stats})",
            f"""c1 AS (SELECT d.day AS t, '{order[0]}' AS c,
                (SELECT count(DISTINCT s.day) FROM st s WHERE s.day < d.day) AS days FROM (SELECT DISTINCT day FROM st) d)""",
            f"champ1 AS (SELECT * FROM c1 WHERE days >= {min_history})"]
    for r, name in enumerate(order[1:], 1):
        m = bound or "greatest(max(u) OVER (PARTITION BY t) - min(u) OVER (PARTITION BY t), 1e-6)"
        ctes += [
            f"""d{r} AS (SELECT *, {m} AS M FROM (SELECT c.t, c.days, a.day AS e, a.b, a.mu - x.mu AS u,
                 a.sq - 2 * a.mu * x.mu + x.sq AS q
                 FROM champ{r} c JOIN st a ON a.expert = c.c AND a.day < c.t
                 JOIN st x ON x.expert = '{name}' AND x.day = a.day))""",
            f"""k{r} AS (SELECT t, days, M, k, size, mu, CASE WHEN size > 1 THEN sqrt(greatest(s2 - 2 * mu * s1 + size * mu * mu, 0)
                 / (size - 1)) ELSE 0 END AS sd FROM (
                 SELECT x.t, x.days, x.M, count(*) AS k, sum(y.b) AS size, sum(y.b * y.u) AS s1, sum(y.b * y.q) AS s2,
                        sum(y.b * y.u) / sum(y.b) AS mu
                 FROM d{r} x JOIN d{r} y ON y.t = x.t AND y.e >= x.e GROUP BY x.t, x.e, x.days, x.M))""",
            f"p{r} AS (SELECT *, {psi} AS psi FROM k{r})",
            f"""s{r} AS (SELECT a.t, a.k, a.mu, round(greatest(max(abs(a.mu - b.mu) - (a.psi + b.psi)), 0) + a.psi, 12) AS s
                 FROM p{r} a JOIN p{r} b ON b.t = a.t AND b.k <= a.k GROUP BY a.t, a.k, a.mu, a.psi)""",
            f"""champ{r + 1} AS (SELECT c.t, CASE WHEN round(w.mu, 12) <= 0 THEN c.c ELSE '{name}' END AS c, c.days
                 FROM champ{r} c JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s, k) AS r FROM s{r}) w
                 ON w.t = c.t AND w.r = 1)"""]
    last = f"champ{len(order)}"
    if fallback is None:
        return sql(f"SELECT t AS day, c AS expert FROM {last}", *ctes)
    return sql(f"SELECT c1.t AS day, coalesce(w.c, '{fallback}') AS expert FROM c1 LEFT JOIN {last} w ON w.t = c1.t",
               *ctes)


LADDER = ["expanding", "roll1", "roll3", "roll7", "roll14"]
_LOG20 = "ln(2 / 0.1)"


@query("adaptive_window", "M3", _tournament_sql(
    f"""SELECT day, expert, count(*) AS b, round(avg({ll('click', 'p')}), 10) AS mu,
        round(avg({ll('click', 'p')} * {ll('click', 'p')}), 10) AS sq FROM bankl GROUP BY day, expert""",
    LADDER, f"(SELECT max({ll('click', 'p')}) + 1e-6 FROM bankl WHERE day < (SELECT test_from FROM day_bounds))",
    f"CASE WHEN size < 2 THEN M ELSE sd * sqrt(2 * {_LOG20} / size) + 8 * M * {_LOG20} / (3 * (size - 1)) END",
    3, None, [*BASE, BANKL]))
def adaptive_window(spark, d) -> DataFrame:
    """Window tournament on row-level loss statistics, rerun for every day from earlier days only."""
    n, k = F.col("n"), F.col("clicks")
    wide = fx.wide_cells(spark, d)
    mu, sq, top = [], [], []
    for e in LADDER:
        hit, miss = sc.log_loss(F.lit(1), F.col(e)), sc.log_loss(F.lit(0), F.col(e))
        mu.append(F.round(F.sum(k * hit + (n - k) * miss) / F.sum("n"), 10))
        sq.append(F.round(F.sum(k * hit * hit + (n - k) * miss * miss) / F.sum("n"), 10))
        top.append(F.max(F.greatest(F.when(k > 0, hit), F.when(n > k, miss))))
    stats = wide.groupBy("day").agg(F.sum("n").alias("b"), F.array(*mu).alias("mu"), F.array(*sq).alias("sq"),
                                    F.greatest(*top).alias("_max"))
    bound = stats.filter(F.col("day") < fx.first_test(spark, d)).agg((F.max("_max") + 1e-6).alias("_bound"))
    limit = bound.collect()[0]["_bound"]
    return mx.tournament(stats.drop("_max"), LADDER, mx.sample_psi(0.1), F.lit(limit)).select("day", "expert")


def _matured_losses(spark, d) -> DataFrame:
    """Day losses on the labels that had arrived by midnight."""
    log = fx.imp(spark, d).withColumn("early", ta.matured_by_midnight(F.col("sec")))
    seen = fx.with_rates(hi.cell_counts(log, ["campaign", "early"])).filter("early")
    return fx.day_losses(hi.long_bank(seen, EXPERTS, ["day", "n", "clicks"]))


@query("arw_daily", "M4", _tournament_sql(
    f"""SELECT day, expert, 1 AS b, round(avg({ll('click', 'p')}), 10) AS mu,
        round(avg({ll('click', 'p')}), 10) * round(avg({ll('click', 'p')}), 10) AS sq
        FROM bankl WHERE sec <= 84600 GROUP BY day, expert""", EXPERTS, None,
    "sd * sqrt(2 * ln(2 / (0.1 / (3.0 * 25 * days))) / k) + 7 * M * ln(2 / (0.1 / (3.0 * 25 * days))) / (3 * greatest(k - 1, 1))",
    3, "expanding", [*BASE, BANKL]))
def arw_daily(spark, d) -> DataFrame:
    """The same tournament on matured daily losses, with a fallback for the first days."""
    vec = mx.day_vectors(_matured_losses(spark, d).withColumn("loss", F.col("key")), [])
    stats = vec.select("day", F.lit(1).alias("b"), F.col("x").alias("mu"),
                       F.transform("x", lambda v: v * v).alias("sq"))
    return mx.tournament(stats, EXPERTS, mx.daily_psi(0.1, K), None, 3, "expanding").select("day", "expert")


_UP, _DOWN = " + ".join(EXPERTS), " + ".join(f"(1 - {e})" for e in EXPERTS)
_SH = ", ".join(f"avg(CASE WHEN click = 1 THEN {e} / ({_UP}) ELSE (1 - {e}) / ({_DOWN}) END) AS l{i}"
                for i, e in enumerate(EXPERTS))


@query("correctness_ema", "M5", sql(MIXED, *BASE,
       f"dlw AS (SELECT day, row_number() OVER (ORDER BY day) AS i, {_SH} FROM bank GROUP BY day)",
       _recursion("fs", [f"0.5 * f.w{i} + 0.5 * l.l{i}" for i in range(K)]), _wt("fs"), recursive=True))
def correctness_ema(spark, d) -> DataFrame:
    shares = mx.correctness_shares(fx.wide_cells(spark, d), EXPERTS)
    return _with_loss(spark, d, mx.ema_of_shares(shares, K, 0.5))


_SOFT = [f"exp(-l.l{i}) / ({' + '.join(f'exp(-l.l{j})' for j in range(K))})" for i in range(K)]
SOFT_PATH = [DLW, _recursion("fs", [f"0.75 * f.w{i} + 0.25 * {_SOFT[i]}" for i in range(K)]), _wt("fs")]


@query("softmax_ema", "M6", sql(MIXED, *LONG, *SOFT_PATH, recursive=True))
def softmax_ema(spark, d) -> DataFrame:
    return _with_loss(spark, d, mx.ema_of_softmax(_losses(spark, d), K, 0.75))


HEDGE = """hl AS (SELECT d.day, c.eta, c.half_life, l.expert, l.ord,
  sum(exp(-ln(2.0) * (d.day - l.day) / c.half_life) * l.loss) / sum(exp(-ln(2.0) * (d.day - l.day) / c.half_life)) AS lb
  FROM (SELECT DISTINCT day FROM dl6) d CROSS JOIN (VALUES (60.0::DOUBLE, 5.0::DOUBLE), (20.0, 5.0), (200.0, 3.0)) c(eta, half_life)
  LEFT JOIN dl6 l ON l.day < d.day GROUP BY ALL),
hw AS (SELECT day, eta, half_life, expert, coalesce(exp(-eta * (lb - min(lb) OVER p)) / sum(exp(-eta * lb)) OVER p
          * exp(-eta * min(lb) OVER p), 0.2) AS w FROM hl WHERE expert IS NOT NULL WINDOW p AS (PARTITION BY day, eta, half_life))"""
DL6 = f"""dl6 AS (SELECT day, expert, ord, avg({ll('click', 'p', '1e-6')}) AS loss FROM bankl GROUP BY day, expert, ord)"""
HEDGE_CONFIGS = [(60.0, 5.0), (20.0, 5.0), (200.0, 3.0)]
_HW = ", ".join(f"coalesce(round(max(w) FILTER (expert = '{e}'), 6), 0.2) AS w_{e}" for e in EXPERTS)


def hedge_weights(spark, d, configs=None) -> DataFrame:
    losses = fx.day_losses(fx.expert_tally(spark, d), eps=sc.MIXTURE_LOSS_CLIP)
    grid = literal_rows(spark, configs or HEDGE_CONFIGS, "eta double, half_life double")
    return mx.discounted_weights(losses, grid)


@query("hedge_discounted", "M7", sql(f"""
SELECT h.day, h.eta, h.half_life, {_HW} FROM (SELECT DISTINCT day, eta, half_life FROM hl) h
LEFT JOIN hw USING (day, eta, half_life) GROUP BY h.day, h.eta, h.half_life""", *BASE, BANKL, DL6, HEDGE))
def hedge_discounted(spark, d) -> DataFrame:
    return _show(hedge_weights(spark, d), ["day", "eta", "half_life"])


def _share_step(eta: str, alpha: str, n: int, w: str = "f.w", loss: str = "l.l") -> list[str]:
    lo = f"least({', '.join(f'{loss}{i}' for i in range(n))})"
    raw = [f"{w}{i} * exp(-{eta} * ({loss}{i} - {lo}))" for i in range(n)]
    return [f"(1 - {alpha}) * {r} / ({' + '.join(raw)}) + {alpha} / {n}" for r in raw]


FS_PATH = [DLW, _recursion("fs", _share_step("2.0", "0.08", K)), _wt("fs")]


@query("fixed_share", "M8", sql(MIXED, *LONG, *FS_PATH, recursive=True))
def fixed_share(spark, d) -> DataFrame:
    return _with_loss(spark, d, mx.fixed_share(_losses(spark, d), K))


_RATES7 = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(mx.SWITCH_RATES))
_SUBW = " + ".join(f"s.w{i} * b.{e}" for i, e in enumerate(EXPERTS))
LEARN = [DLW, f"""sub AS (
  SELECT CAST(1 AS BIGINT) AS i, sub, alpha, {', '.join(f'CAST(0.2 AS DOUBLE) AS w{i}' for i in range(K))}
  FROM (VALUES {_RATES7}) r(sub, alpha)
  UNION ALL SELECT f.i + 1, f.sub, f.alpha, {', '.join(_share_step('2.0', 'f.alpha', K))}
  FROM sub f JOIN dlw l ON l.i = f.i)""",
  f"""sl AS (SELECT s.i, s.sub, avg({ll('b.click', _SUBW)}) AS loss FROM sub s JOIN dlw l ON l.i = s.i
         JOIN bank b ON b.day = l.day GROUP BY s.i, s.sub)""",
  "slw AS (SELECT i, " + ", ".join(f"max(loss) FILTER (sub = {j}) AS l{j}" for j in range(7)) + " FROM sl GROUP BY i)",
  f"""top AS (SELECT CAST(1 AS BIGINT) AS i, {', '.join(f'CAST(1.0 / 7 AS DOUBLE) AS w{j}' for j in range(7))}
  UNION ALL SELECT f.i + 1, {', '.join(_share_step('2.0', '0.0', 7))} FROM top f JOIN slw l ON l.i = f.i)""",
  "tl AS (SELECT i, sub, CASE sub " + " ".join(f"WHEN {j} THEN w{j}" for j in range(7)) + " END AS v FROM top CROSS JOIN range(7) r(sub))",
  f"""wt AS (SELECT l.day, sum(t.v * s.alpha) AS mean_alpha, {', '.join(f'sum(t.v * s.w{i}) AS w_{e}' for i, e in enumerate(EXPERTS))}
  FROM sub s JOIN tl t ON t.i = s.i AND t.sub = s.sub JOIN dlw l ON l.i = s.i GROUP BY l.day)"""]


@query("learn_alpha", "M9", sql(MIXED.replace("SELECT w.day,", "SELECT w.day, round(any_value(w.mean_alpha), 6) AS mean_alpha,"),
                                *LONG, *LEARN, recursive=True))
def learn_alpha(spark, d) -> DataFrame:
    wide, losses = fx.wide_cells(spark, d), _losses(spark, d)
    weights = mx.learn_switch_rate(wide, losses, EXPERTS)
    out = _with_loss(spark, d, weights.select("day", "w"))
    return out.join(weights.select("day", r6("mean_alpha")), "day")


@query("global_blend", "M10", sql(f"""
SELECT c.day, c.alpha, o.alpha AS alpha_oracle, round(c.loss, 6) AS loss, round(c.loss - o.loss, 6) AS headroom
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(past, 8), alpha) AS r FROM gp WHERE past IS NOT NULL) c
JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(loss, 10), alpha) AS r FROM gp) o
  ON o.day = c.day AND o.r = 1 WHERE c.r = 1""", *BASE, f"""
g AS (SELECT day, alpha, sum({ll('click', '(1 - alpha) * expanding + alpha * roll3')}) AS s, count(*) AS n
      FROM bank CROSS JOIN (SELECT (i / 10.0)::DOUBLE AS alpha FROM range(11) r(i)) GROUP BY day, alpha)""",
      """gp AS (SELECT g.day, g.alpha, g.s / g.n AS loss, (SELECT sum(h.s) FROM g h WHERE h.alpha = g.alpha
      AND h.day < g.day AND h.day >= g.day - 3) AS past FROM g)"""))
def global_blend(spark, d) -> DataFrame:
    grid = mx.blend_grid(fx.wide_cells(spark, d), hi.SHORT, hi.LONG)
    out = mx.global_blend(grid)
    return out.select("day", "alpha", "alpha_oracle", r6("loss"), r6("headroom"))


HISTORY = 14


@query("period_detect", "M19", sql("""
SELECT d.day, CAST(CASE WHEN b.acf >= 0.3 THEN b.lag END AS DOUBLE) AS period, round(b.acf, 6) AS acf FROM s d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(acf, 10) DESC, lag) AS r FROM a) b
  ON b.day = d.day AND b.r = 1""", *LONG,
  "s AS (SELECT day, loss, row_number() OVER (ORDER BY day) AS i FROM dl WHERE expert = 'expanding')",
  """c AS (SELECT t.day, t.i AS n1, x.i AS j, x.loss - avg(x.loss) OVER (PARTITION BY t.day) AS c
       FROM s t JOIN s x ON x.i < t.i)""",
  """a AS (SELECT c.day, CAST(g.lag AS INTEGER) AS lag, sum(c.c * z.c) / (SELECT sum(q.c * q.c) FROM c q WHERE q.day = c.day) AS acf
       FROM c CROSS JOIN range(3, 26) g(lag) JOIN c z ON z.day = c.day AND z.j = c.j + g.lag
       WHERE c.n1 - 1 >= 14 AND g.lag <= c.n1 - 2 GROUP BY c.day, g.lag)"""))
def period_detect(spark, d) -> DataFrame:
    """Cycle of the long window's loss, from strictly earlier days."""
    series = _losses(spark, d).filter(F.col("expert") == hi.LONG)
    out = mx.cycle_length(series, 3, 25, HISTORY)
    return out.select("day", F.col("period").cast("double").alias("period"), r6("acf"))
