"""Queries: statistics on day-level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import auction as au
from tidelog.operators import daystats as ds
from tidelog.operators import diagnostics as dg
from tidelog.operators import history as hi
from tidelog.operators import metrics as me
from tidelog.plans import auction_queries as aq
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, METH, REC, SEEDED, ll, sql
from tidelog.session import settle

BASELINE = "expanding"
BOOTS = 1000
RIVALS = [m for m in fx.METHODS if m != BASELINE]


def deltas(spark, d) -> DataFrame:
    """Daily loss difference of every method against the long window."""
    per = fx.per_day(spark, d)
    base = per.filter(F.col("method") == BASELINE).select("day", F.col("log_loss").alias("base_loss"))
    return per.filter(F.col("method") != BASELINE).join(base, "day").select(
        "method", "day", "n", "log_loss", "base_loss", (F.col("log_loss") - F.col("base_loss")).alias("delta"))


DELTA = """dd AS (SELECT a.method, a.day, a.n, a.log_loss, b.log_loss AS base_loss, a.log_loss - b.log_loss AS delta,
  row_number() OVER (PARTITION BY a.method ORDER BY a.day) - 1 AS j, count(*) OVER (PARTITION BY a.method) AS m
  FROM pd a JOIN pd b ON b.day = a.day AND b.method = 'expanding' WHERE a.method <> 'expanding')"""
_DRAW = "('0x' || substr(md5(bt.b || ':' || ps.j), 1, 8))::BIGINT"
BOOT = f"""bs AS (SELECT c.method, bt.b, {{stat}} AS s
  FROM (SELECT DISTINCT method, m FROM dd) c CROSS JOIN range({BOOTS}) bt(b) CROSS JOIN range(100) ps(j)
  JOIN dd x ON x.method = c.method AND x.j = {_DRAW} % c.m WHERE ps.j < c.m GROUP BY c.method, bt.b)"""
CI = "ci AS (SELECT method, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM bs GROUP BY method)"
MBB = f"""mb AS (SELECT c.method, bt.b, avg(x.delta) AS s
  FROM (SELECT DISTINCT method, m FROM dd) c CROSS JOIN range({BOOTS}) bt(b) CROSS JOIN range(100) ps(j)
  CROSS JOIN range(2) o(k) JOIN dd x ON x.method = c.method AND x.j = {_DRAW} % (c.m - 1) + o.k
  WHERE ps.j < ceil(c.m / 2.0) AND ps.j * 2 + o.k < c.m AND c.m >= 4 GROUP BY c.method, bt.b),
mci AS (SELECT method, quantile_cont(s, 0.025) AS mlo, quantile_cont(s, 0.975) AS mhi FROM mb GROUP BY method)"""


@query("paired_bootstrap", "T1", sql("""
SELECT a.method, a.days, round(a.mean, 6) AS mean, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi
FROM (SELECT method, count(*) AS days, avg(delta) AS mean FROM dd GROUP BY method) a JOIN ci c ON c.method = a.method""",
    *METH, DELTA, BOOT.format(stat="avg(x.delta)"), CI))
def paired_bootstrap(spark, d) -> DataFrame:
    out = ds.bootstrap_mean(deltas(spark, d), ["method"], n_boot=BOOTS)
    return out.select("method", F.col("days").cast("long").alias("days"), r6("mean"), r6("lo"), r6("hi"))


@query("weighted_block_bootstrap", "T2", sql("""
SELECT a.method, round(a.mean, 6) AS mean, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi
FROM (SELECT method, sum(log_loss * n) / sum(n) AS mean FROM dd GROUP BY method) a JOIN ci c ON c.method = a.method""",
    *METH, DELTA, BOOT.format(stat="sum(x.log_loss * x.n) / sum(x.n)"), CI))
def weighted_block_bootstrap(spark, d) -> DataFrame:
    out = ds.bootstrap_weighted(deltas(spark, d), ["method"], "log_loss", "n", BOOTS)
    return out.select("method", r6("mean"), r6("lo"), r6("hi"))


@query("moving_block_bootstrap", "T3", sql("""
SELECT a.method, round(a.mean, 6) AS mean, round(c.mlo, 6) AS lo, round(c.mhi, 6) AS hi
FROM (SELECT method, avg(delta) AS mean FROM dd GROUP BY method) a LEFT JOIN mci c ON c.method = a.method""", *METH, DELTA, MBB))
def moving_block_bootstrap(spark, d) -> DataFrame:
    out = ds.bootstrap_blocks(deltas(spark, d), ["method"], n_boot=BOOTS)
    return out.select("method", r6("mean"), r6("lo"), r6("hi"))


SPEND_SHARE = 0.25
DAY_CLICKS = [f"tg AS (SELECT day, {SPEND_SHARE}::DOUBLE * sum(cost) AS target FROM bid WHERE method = 'expanding' GROUP BY day)",
              """pt AS (SELECT method, day, spend, clicks, lead(spend) OVER w AS ns, lead(clicks) OVER w AS nc, first(clicks) OVER w AS first_c
  FROM fr WINDOW w AS (PARTITION BY method, day ORDER BY spend, step))""",
              """cl AS (SELECT g.method, g.day, coalesce(CASE WHEN p.ns IS NULL THEN p.clicks
    ELSE p.clicks + (p.nc - p.clicks) / (p.ns - p.spend) * (t.target - p.spend) END, g.first_c) AS clicks
  FROM (SELECT method, day, min(first_c) AS first_c FROM pt GROUP BY method, day) g JOIN tg t ON t.day = g.day
  LEFT JOIN pt p ON p.method = g.method AND p.day = g.day AND p.spend <= t.target AND (p.ns IS NULL OR p.ns > t.target)
    AND (p.ns IS NULL OR p.ns > p.spend))""",
              """dd AS (SELECT a.method, a.day, a.clicks, b.clicks AS base_clicks,
    row_number() OVER (PARTITION BY a.method ORDER BY a.day) - 1 AS j, count(*) OVER (PARTITION BY a.method) AS m
  FROM cl a JOIN cl b ON b.day = a.day AND b.method = 'expanding' WHERE a.method <> 'expanding')"""]


def clicks_by_day(spark, d) -> DataFrame:
    """(method, day, clicks, base_clicks): what each method and the long window win on a day at a quarter of the day's cost."""
    rows = aq.bids(spark, d)
    targets = rows.filter(F.col("method") == BASELINE).groupBy("day").agg((SPEND_SHARE * F.sum("cost")).alias("target"))
    fr = au.linear_frontier(rows, ["method", "day"])
    won = settle(au.value_at_spend(fr, ["method", "day"], targets, clamp_left=True).select("method", "day", F.col("clicks_at").alias("clicks")))
    base = won.filter(F.col("method") == BASELINE).select("day", F.col("clicks").alias("base_clicks"))
    return won.filter(F.col("method") != BASELINE).join(base, "day")


@query("ratio_bootstrap", "T4", sql("""
SELECT a.method, a.days, round(a.ratio, 6) AS ratio, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi
FROM (SELECT method, count(*) AS days, sum(clicks) / sum(base_clicks) AS ratio FROM dd GROUP BY method) a JOIN ci c ON c.method = a.method""",
    *BASE, REC, aq.BID, *aq.frontier_ctes("bid", "method, day", "fr"), *DAY_CLICKS,
    BOOT.format(stat="sum(x.clicks) / sum(x.base_clicks)"), CI))
def ratio_bootstrap(spark, d) -> DataFrame:
    """Clicks at matched spend against the long window's: ratio of the days' sums, whole days resampled."""
    out = ds.bootstrap_ratio(clicks_by_day(spark, d), ["method"], "clicks", "base_clicks", BOOTS)
    return out.select("method", F.col("days").cast("long").alias("days"), r6("ratio"), r6("lo"), r6("hi"))


LOO = """loo AS (SELECT method, day, (sum(delta) OVER (PARTITION BY method) - delta) / (m - 1) AS loo FROM dd)"""


@query("leave_one_day_out", "T5", sql("""
SELECT l.method, l.day, round(l.loo, 6) AS loo FROM loo l""", *METH, DELTA, LOO))
def leave_one_day_out(spark, d) -> DataFrame:
    return ds.leave_one_out(deltas(spark, d), ["method"]).select("method", "day", r6("loo"))


WINS = """wins AS (SELECT method, count(*) AS days, count(*) FILTER (delta < -1e-9) AS won,
  count(*) FILTER (delta > 1e-9) AS lost, count(*) FILTER (abs(delta) <= 1e-9) AS tied FROM dd GROUP BY method)"""


def _cdf(k: str, n: str) -> str:
    return (f"(SELECT coalesce(sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0))), 0) "
            f"FROM range(0, 400) r(i) WHERE i <= {k})")


@query("sign_test", "T6", sql(f"""
SELECT method, won, lost, tied,
  round(least(1.0, 2 * {_cdf('least(won, lost)', '(won + lost)')}), 6) AS p_two_sided,
  round(1 - {_cdf('won - 1', '(won + lost)')}, 6) AS p_one_sided,
  round(least(1.0, pow(2.0, 1 - (won + lost))), 6) AS p_floor FROM wins""", *METH, DELTA, WINS))
def sign_test(spark, d) -> DataFrame:
    w = ds.win_counts(deltas(spark, d), ["method"])
    tests = ds.sign_tests(F.col("won"), F.col("won") + F.col("lost"))
    return w.select("method", "won", "lost", "tied", *[r6(c, k) for k, c in tests.items()])


RANKS = """nz AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY abs(delta))
                  + (count(*) OVER (PARTITION BY method, abs(delta)) - 1) / 2.0::DOUBLE AS r,
                  count(*) OVER (PARTITION BY method, abs(delta)) AS t FROM ddr WHERE delta <> 0),
ws AS (SELECT method, count(*) AS n, coalesce(sum(r) FILTER (delta > 0), 0) AS wp, coalesce(sum(r) FILTER (delta < 0), 0) AS wm,
              max(t) AS ties, sum(t * t - 1) AS tc, any_value(m) AS m FROM nz GROUP BY method),
dist AS (SELECT 0 AS k, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c
  UNION ALL SELECT k + 1, list_transform(range(0, 1276), lambda i: c[i + 1] + CASE WHEN i >= k + 1 THEN c[i - k] ELSE 0 END)
  FROM dist WHERE k < 50)"""
_ERF = "exp(-x * x) * (SELECT sum(exp((2 * q + 1) * ln(x) - lgamma(q + 1.5))) FROM range(0, 150) z(q))"


@query("wilcoxon", "T7", sql(f"""
SELECT method, n, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, exact, round(CASE WHEN exact THEN
    least(1.0, 2 * (SELECT list_sum(list_slice(c, 1, CAST(floor(least(wp, wm)) AS BIGINT) + 1)) FROM dist WHERE k = n) / pow(2.0, n))
  ELSE greatest(0, 1 - {_ERF}) END, 6) AS p
FROM (SELECT *, ties = 1 AND n = m AND n <= 50 AS exact, abs(least(wp, wm) - n * (n + 1) / 4.0::DOUBLE)
  / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tc / 48.0::DOUBLE) / sqrt(2.0) AS x FROM ws)""",
    *METH, DELTA, "ddr AS (SELECT method, day, m, round(delta, 10) AS delta FROM dd)", RANKS, recursive=True))
def wilcoxon(spark, d) -> DataFrame:
    rounded = deltas(spark, d).withColumn("delta", F.round("delta", 10))
    out = ds.signed_rank(rounded, ["method"])
    return out.select("method", "n", r6("w_plus"), r6("w_minus"), "exact", r6("p"))


@query("holm", "T8", sql(f"""
SELECT method, round(p, 6) AS p, round(least(1.0, max((c - r + 1) * p) OVER (ORDER BY r)), 6) AS p_holm FROM (
  SELECT method, p, row_number() OVER (ORDER BY p, method) AS r, count(*) OVER () AS c FROM (
    SELECT method, round(least(1.0, 2 * {_cdf('least(won, lost)', '(won + lost)')}), 10) AS p FROM wins))""",
    *METH, DELTA, WINS))
def holm(spark, d) -> DataFrame:
    w = ds.win_counts(deltas(spark, d), ["method"])
    p = ds.sign_tests(F.col("won"), F.col("won") + F.col("lost"))["p_two_sided"]
    out = ds.holm(w.select("method", F.lit(1).alias("family"), F.round(p, 10).alias("p")), ["family"], "method")
    return out.select("method", r6("p"), r6("p_holm"))


@query("day_summary", "T9", sql(f"""
SELECT a.method, a.days, round(a.mean, 6) AS mean, round(a.med, 6) AS median, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi,
  round(m.mlo, 6) AS mbb_lo, round(m.mhi, 6) AS mbb_hi, a.won, round(a.worst, 6) AS worst,
  round(l.lmin, 6) AS loo_min, round(l.lmax, 6) AS loo_max
FROM (SELECT method, count(*) AS days, avg(delta) AS mean, quantile_cont(delta, 0.5) AS med, max(delta) AS worst,
             count(*) FILTER (round(delta, 10) < 0) AS won FROM dd GROUP BY method) a
JOIN ci c ON c.method = a.method JOIN mci m ON m.method = a.method
JOIN (SELECT method, min(loo) AS lmin, max(loo) AS lmax FROM loo GROUP BY method) l ON l.method = a.method""",
    *METH, DELTA, BOOT.format(stat="avg(x.delta)"), CI, MBB, LOO))
def day_summary(spark, d) -> DataFrame:
    rounded = deltas(spark, d).withColumn("delta", F.round("delta", 10))
    out = ds.summary(rounded, ["method"], n_boot=BOOTS)
    cols = ["mean", "median", "lo", "hi", "mbb_lo", "mbb_hi"]
    return out.select("method", F.col("days").cast("long").alias("days"), *[r6(c) for c in cols], "won",
                      r6("worst"), r6("loo_min"), r6("loo_max"))


@query("paired_table", "T10", sql("""
SELECT a.method, round(a.ml, 6) AS mean_loss, round(a.md, 6) AS mean_gain, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi,
  w.won, w.lost, w.tied, round(100 * a.md / a.mb, 6) AS rel_pct
FROM (SELECT method, avg(log_loss) AS ml, avg(delta) AS md, avg(base_loss) AS mb FROM dd GROUP BY method) a
JOIN ci c ON c.method = a.method JOIN wins w ON w.method = a.method""",
    *METH, DELTA, BOOT.format(stat="avg(x.delta)"), CI, WINS))
def paired_table(spark, d) -> DataFrame:
    rows = deltas(spark, d)
    level = rows.groupBy("method").agg(F.avg("log_loss").alias("mean_loss"), F.avg("base_loss").alias("_b"))
    out = ds.bootstrap_mean(rows, ["method"], n_boot=BOOTS).join(level, "method").join(
        ds.win_counts(rows, ["method"]).drop("days"), "method")
    return out.select("method", r6("mean_loss"), r6("mean", "mean_gain"), r6("lo"), r6("hi"), "won", "lost", "tied",
                      r6(100 * F.col("mean") / F.col("_b"), "rel_pct"))


# The four cells of the factorial: history rule x equal mixing.
CELLS4 = {"c00": "expanding", "c01": "uniform5", "c10": "roll3", "c11": "roll7"}
EFFECTS = {"mix_given_long": ("c01", "c00"), "mix_given_short": ("c11", "c10"),
           "short_given_none": ("c10", "c00"), "short_given_mix": ("c11", "c01")}
_EFF = " UNION ALL ".join(f"SELECT '{k}' AS method, day, {a} - {b} AS delta FROM w4" for k, (a, b) in EFFECTS.items())
_EFF += " UNION ALL SELECT 'interaction', day, (c11 - c10) - (c01 - c00) FROM w4"
W4 = "w4 AS (SELECT day, " + ", ".join(f"max(log_loss) FILTER (method = '{m}') AS {c}" for c, m in CELLS4.items()) + " FROM pd GROUP BY day)"


@query("factorial_2x2", "T11", sql("""
SELECT a.method AS effect, round(a.mean, 6) AS mean, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi, a.neg_days
FROM (SELECT method, avg(delta) AS mean, count(*) FILTER (round(delta, 10) < 0) AS neg_days FROM dd GROUP BY method) a
JOIN ci c ON c.method = a.method""", *METH, W4, f"""dd AS (SELECT *,
  row_number() OVER (PARTITION BY method ORDER BY day) - 1 AS j, count(*) OVER (PARTITION BY method) AS m FROM ({_EFF}))""",
    BOOT.format(stat="avg(x.delta)"), CI))
def factorial_2x2(spark, d) -> DataFrame:
    """Marginal effects of two factors and their interaction, paired by day."""
    wide = fx.per_day(spark, d).groupBy("day").pivot("method", list(CELLS4.values())).agg(F.max("log_loss"))
    wide = wide.select("day", *[F.col(m).alias(c) for c, m in CELLS4.items()])
    effects = {k: F.col(a) - F.col(b) for k, (a, b) in EFFECTS.items()}
    effects["interaction"] = (F.col("c11") - F.col("c10")) - (F.col("c01") - F.col("c00"))
    rows = wide.select("day", F.inline(F.array(*[
        F.struct(F.lit(k).alias("effect"), v.alias("delta")) for k, v in effects.items()])))
    neg = rows.groupBy("effect").agg(F.count_if(F.round("delta", 10) < 0).alias("neg_days"))
    out = ds.bootstrap_mean(rows, ["effect"], n_boot=BOOTS).join(neg, "effect")
    return out.select("effect", r6("mean"), r6("lo"), r6("hi"), "neg_days")


REGIME = f"""rg AS (SELECT seed, grp AS regime, method, ord, avg({ll('click', 'p')}) AS l FROM srec GROUP BY seed, grp, method, ord),
best AS (SELECT regime, method AS oracle, lm FROM (SELECT regime, method, avg(l) AS lm,
  row_number() OVER (PARTITION BY regime ORDER BY round(avg(l), 10), ord) AS r FROM rg WHERE method <> 'uniform5'
  GROUP BY regime, method, ord) WHERE r = 1),
ex AS (SELECT g.method, g.regime, g.seed, g.l - b.lm AS excess FROM rg g JOIN best b USING (regime))"""


@query("excess_vs_oracle", "T12", sql("""
SELECT method, round(avg(excess), 6) AS mean_excess, round((SELECT max(w) FROM (
  SELECT avg(e.excess) AS w FROM ex e WHERE e.method = ex.method GROUP BY e.regime)), 6) AS worst_regime
FROM ex GROUP BY method""", *SEEDED, REGIME))
def excess_vs_oracle(spark, d) -> DataFrame:
    """Excess over the best window of each regime in hindsight, on average and in the worst regime."""
    seeded = fx.seeded(fx.imp(spark, d))
    counted = hi.cell_counts(seeded, ["seed", "campaign", "grp"])
    wide = hi.uniform_mix(fx.eligible(hi.rate_bank(counted, ["seed", "campaign"])), hi.WINDOW_ORDER)
    tally = hi.long_bank(wide, fx.METHODS, ["seed", "grp", "n", "clicks"])
    loss = me.mean_losses(tally.withColumnsRenamed({"expert": "method", "grp": "regime"}),
                          ["seed", "regime", "method", "ord"])
    mean = loss.groupBy("regime", "method", "ord").agg(F.avg("log_loss").alias("loss"))
    best = dg.best_per(mean.filter(F.col("method").isin(hi.WINDOW_ORDER)), ["regime"], name="method")
    excess = loss.join(best.select("regime", F.col("loss").alias("_o")), "regime").withColumn(
        "excess", F.col("log_loss") - F.col("_o"))
    per = excess.groupBy("method", "regime").agg(F.avg("excess").alias("e"), F.sum("excess").alias("s"),
                                                 F.count("*").alias("c"))
    return per.groupBy("method").agg(r6(F.sum("s") / F.sum("c"), "mean_excess"), r6(F.max("e"), "worst_regime"))


@query("impression_weighted_effect", "T13", sql("""
SELECT method, round(sum(delta * n) / sum(n), 6) AS pooled, round(avg(delta), 6) AS daily FROM dd GROUP BY method""",
    *METH, DELTA))
def impression_weighted_effect(spark, d) -> DataFrame:
    return ds.pooled_effect(deltas(spark, d), ["method"]).select("method", r6("pooled"), r6("daily"))
