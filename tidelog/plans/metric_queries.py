"""Queries: per-day metrics and their aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import diagnostics as dg
from tidelog.operators import history as hi
from tidelog.operators import metrics as me
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, BANKL, METH, REC, SEEDED, lg, ll, rates, sql
from tidelog.session import literal_rows

ECE_SQL = """ece AS (
  SELECT method, day, sum(abs(sp - sk)) / sum(nb) AS ece FROM (
    SELECT method, day, least(floor(p * 15), 14) AS bin, sum(p) AS sp, sum(click) AS sk, count(*) AS nb
    FROM rec GROUP BY method, day, least(floor(p * 15), 14)) GROUP BY method, day)"""
AUC_SQL = """auc AS (
  SELECT method, day, CASE WHEN sum(click) > 0 AND sum(click) < count(*) THEN
    (sum(rk) FILTER (click = 1) - sum(click) * (sum(click) + 1) / 2.0::DOUBLE) / (sum(click) * sum(1 - click)::DOUBLE) END AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY method, day ORDER BY p)
               + (count(*) OVER (PARTITION BY method, day, p) - 1) / 2.0::DOUBLE AS rk FROM rec)
  GROUP BY method, day)"""
AP_SQL = """ap AS (
  SELECT method, day, CASE WHEN max(tk) > 0 AND max(tk) < max(tn) THEN sum(k * ck / cn::DOUBLE) / max(tk) END AS pr_auc
  FROM (SELECT method, day, p, k, sum(k) OVER w AS ck, sum(n) OVER w AS cn,
               sum(k) OVER (PARTITION BY method, day) AS tk, sum(n) OVER (PARTITION BY method, day) AS tn
        FROM (SELECT method, day, p, sum(click) AS k, count(*) AS n FROM rec GROUP BY method, day, p)
        WINDOW w AS (PARTITION BY method, day ORDER BY p DESC))
  GROUP BY method, day)"""
FULL = [*METH, ECE_SQL, AUC_SQL, AP_SQL]


@query("day_metrics", "A1", sql("""
SELECT method, day, n, clicks, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(ece, 6) AS ece,
       round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
FROM pd JOIN ece USING (method, day) JOIN auc USING (method, day) JOIN ap USING (method, day)""", *FULL))
def day_metrics(spark, d) -> DataFrame:
    out = me.day_metrics(fx.method_tally(spark, d), ["method", "day"])
    return out.select("method", "day", "n", "clicks",
                      *[r6(c) for c in ("log_loss", "brier", "ece", "roc_auc", "pr_auc")])


@query("log_loss_brier", "A2", sql(
    "SELECT method, day, n, clicks, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM pd", *METH))
def log_loss_brier(spark, d) -> DataFrame:
    out = me.mean_losses(fx.method_tally(spark, d), ["method", "day"])
    return out.select("method", "day", "n", "clicks", r6("log_loss"), r6("brier"))


@query("ece", "A3", sql("SELECT method, day, round(ece, 6) AS ece FROM ece", *METH, ECE_SQL))
def ece(spark, d) -> DataFrame:
    return me.calibration_error(fx.method_tally(spark, d), ["method", "day"]).select("method", "day", r6("ece"))


@query("roc_auc", "A4", sql("SELECT method, day, round(roc_auc, 6) AS roc_auc FROM auc", *METH, AUC_SQL))
def roc_auc(spark, d) -> DataFrame:
    out = me.ranking_metrics(fx.method_tally(spark, d), ["method", "day"])
    return out.select("method", "day", r6("roc_auc"))


@query("average_precision", "A5", sql("SELECT method, day, round(pr_auc, 6) AS pr_auc FROM ap", *METH, AP_SQL))
def average_precision(spark, d) -> DataFrame:
    out = me.ranking_metrics(fx.method_tally(spark, d), ["method", "day"], exact_slices=True)
    return out.select("method", "day", r6("pr_auc"))


@query("group_metrics", "A6", sql(f"""
SELECT method, day, coalesce(grp, 'overall') AS grp, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks,
       round(avg({ll('click', 'p')}), 6) AS log_loss, round(avg((p - click) * (p - click)), 6) AS brier
FROM rec GROUP BY GROUPING SETS ((method, day, grp), (method, day))""", *BASE, REC))
def group_metrics(spark, d) -> DataFrame:
    out = me.with_overall(fx.method_tally(spark, d, grp=F.col("grp")), ["method", "day"], "grp")
    return out.select("method", "day", "grp", "n", "clicks", r6("log_loss"), r6("brier"))


@query("comparison_table", "A7", sql("""
SELECT method, CAST(sum(n) AS BIGINT) AS n, count(*) AS days, round(sum(log_loss * n) / sum(n), 6) AS log_loss,
       round(sum(brier * n) / sum(n), 6) AS brier, round(avg(pr_auc), 6) AS pr_auc, round(avg(roc_auc), 6) AS roc_auc
FROM pd JOIN auc USING (method, day) JOIN ap USING (method, day) WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY method""", *FULL))
def comparison_table(spark, d) -> DataFrame:
    tally = fx.method_tally(spark, d).filter(F.col("day") >= fx.first_test(spark, d))
    per_day = me.mean_losses(tally, ["method", "day"]).join(
        me.ranking_metrics(tally, ["method", "day"]), ["method", "day"])
    return me.comparison(per_day, ["method"]).select(
        "method", "n", "days", r6("log_loss"), r6("brier"), r6("pr_auc"), r6("roc_auc"))


@query("weighted_mean", "A8", sql("""
SELECT method, round(sum(roc_auc * n) / sum(n), 6) AS weighted FROM pd JOIN auc USING (method, day)
WHERE roc_auc IS NOT NULL GROUP BY method""", *METH, AUC_SQL))
def weighted_mean(spark, d) -> DataFrame:
    tally = fx.method_tally(spark, d)
    per_day = me.mean_losses(tally, ["method", "day"]).join(
        me.ranking_metrics(tally, ["method", "day"]), ["method", "day"])
    return per_day.groupBy("method").agg(r6(me.weighted_mean(F.col("roc_auc"), F.col("n")), "weighted"))


@query("pooled_and_daily", "A9", sql("""
SELECT method, round(sum(log_loss * n) / sum(n), 6) AS iw_log_loss, round(avg(log_loss), 6) AS daily_mean,
       round(max(log_loss), 6) AS worst_day, round(quantile_cont(log_loss, 0.5), 6) AS median_day
FROM pd GROUP BY method""", *METH))
def pooled_and_daily(spark, d) -> DataFrame:
    out = me.pooled_and_daily(fx.per_day(spark, d), ["method"])
    return out.select("method", *[r6(c) for c in ("iw_log_loss", "daily_mean", "worst_day", "median_day")])


INNER = """origins AS (SELECT DISTINCT day AS origin FROM imp WHERE day >= (SELECT test_from FROM day_bounds)),
inner3 AS (SELECT origin, inner_day, recency FROM (
  SELECT o.origin, d.day AS inner_day, row_number() OVER (PARTITION BY o.origin ORDER BY d.day DESC) AS recency
  FROM origins o JOIN (SELECT DISTINCT day FROM imp WHERE day >= 4) d ON d.day < o.origin) WHERE recency <= 3)"""


@query("matured_iw_loss", "A10", sql(f"""
SELECT t.origin, b.expert, count(*) AS n, round(avg({ll('click', 'p')}), 6) AS loss
FROM inner3 t JOIN bankl b ON b.day = t.inner_day
WHERE CAST(b.day AS BIGINT) * 86400 + b.sec + 1800 <= CAST(t.origin AS BIGINT) * 86400
GROUP BY t.origin, b.expert""", *BASE, BANKL, INNER))
def matured_iw_loss(spark, d) -> DataFrame:
    """Inner loss of each expert on the labels that had arrived by the origin.

    Tallies carry the day's tail as a flag, so the origins meet daily cells only.
    """
    early = ta.matured_by_midnight(F.col("sec"))
    tally = fx.method_tally(spark, d, early=early).filter(F.col("method") != "uniform5")
    daily = tally.groupBy("day", "early", "method").agg(
        F.sum("n").alias("n"), F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))).alias("s"))
    days = sp.day_axis(fx.cells(spark, d))
    pairs = sp.inner_days(days, days.filter(F.col("day") >= fx.first_test(spark, d)), 3, fx.FIRST_ELIGIBLE)
    lag = F.when(F.col("early"), 1).otherwise(2)
    used = pairs.join(daily, (F.col("inner_day") == F.col("day")) & (F.col("day") + lag <= F.col("origin")))
    return used.groupBy("origin", F.col("method").alias("expert")).agg(
        F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n"), "loss"))


@query("intraday_blocks", "A11", sql(f"""
SELECT method, CAST(sec // 3600 AS INTEGER) AS block, count(*) AS n, round(avg(click - p), 6) AS residual,
       round(avg({ll('click', 'p')}), 6) AS log_loss
FROM rec GROUP BY method, sec // 3600""", *BASE, REC))
def intraday_blocks(spark, d) -> DataFrame:
    t = fx.method_tally(spark, d, block=ta.block_of(F.col("sec"), 3600))
    loss = sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))
    return t.groupBy("method", "block").agg(
        F.sum("n").alias("n"), r6(F.sum(F.col("clicks") - F.col("n") * F.col("p")) / F.sum("n"), "residual"),
        r6(F.sum(loss) / F.sum("n"), "log_loss"))


@query("early_mid_late", "A12", sql(f"""
SELECT method, CASE WHEN sec < 28800 THEN 'early' WHEN sec < 57600 THEN 'mid' ELSE 'late' END AS third,
       count(*) AS n, round(avg({ll('click', 'p')}), 6) AS log_loss
FROM rec GROUP BY ALL""", *BASE, REC))
def early_mid_late(spark, d) -> DataFrame:
    third = F.when(F.col("sec") < 28800, "early").when(F.col("sec") < 57600, "mid").otherwise("late")
    out = me.mean_losses(fx.method_tally(spark, d, third=third), ["method", "third"])
    return out.select("method", "third", "n", r6("log_loss"))


@query("temporal_metrics", "A13", sql(f"""
SELECT method, round(avg({ll('click', 'p')}) FILTER (sec < 1800), 6) AS pre_feedback,
       round(avg({ll('click', 'p')}) FILTER (sec < 21600), 6) AS first_quarter,
       round((SELECT max(log_loss) FROM pd WHERE pd.method = rec.method), 6) AS worst_day
FROM rec GROUP BY method""", *METH))
def temporal_metrics(spark, d) -> DataFrame:
    phase = F.when(F.col("sec") < 1800, "pre").when(F.col("sec") < 21600, "quarter").otherwise("rest")
    daily = fx.method_tally(spark, d, phase=phase).groupBy("method", "day", "phase").agg(
        F.sum("n").alias("n"), F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), F.col("p"))).alias("s"))
    per_day = daily.groupBy("method", "day").agg(
        (F.sum("s") / F.sum("n")).alias("loss"),
        *[F.sum(F.when(F.col("phase") == c, F.col(v))).alias(f"{v}_{c}") for c in ("pre", "quarter") for v in "sn"])
    pre_s, pre_n = F.sum("s_pre"), F.sum("n_pre")
    return per_day.groupBy("method").agg(
        r6(pre_s / pre_n, "pre_feedback"),
        r6((pre_s + F.sum("s_quarter")) / (pre_n + F.sum("n_quarter")), "first_quarter"),
        r6(F.max("loss"), "worst_day"))


@query("seed_average", "A14", sql("""
SELECT method, day, round(avg(log_loss), 6) AS mean_loss, round(stddev_samp(log_loss), 6) AS sd_loss,
       round(avg(n), 6) AS mean_n, count(DISTINCT seed) AS n_seeds FROM spd GROUP BY method, day""", *SEEDED))
def seed_average(spark, d) -> DataFrame:
    out = me.seed_mean(fx.per_day_seed(spark, d), ["method", "day"])
    return out.select("method", "day", r6("mean_loss"), r6("sd_loss"), r6("mean_n"), "n_seeds")


@query("seed_average_wide", "A14", sql("""
SELECT day, """ + ", ".join(f"round(avg(log_loss) FILTER (method = '{m}'), 6) AS {m}" for m in fx.METHODS) + """
FROM spd GROUP BY day""", *SEEDED))
def seed_average_wide(spark, d) -> DataFrame:
    wide = fx.per_day_seed(spark, d).groupBy("day").pivot("method", fx.METHODS).agg(F.avg("log_loss"))
    return wide.select("day", *[r6(m) for m in fx.METHODS])


CONSOL = """pseed AS (SELECT method, seed, sum(log_loss * n) / sum(n) AS log_loss, sum(brier * n) / sum(n) AS brier,
                      CASE WHEN day >= (SELECT test_from FROM day_bounds) THEN 'test' ELSE 'dev' END AS role
               FROM spd GROUP BY ALL)"""


def _per_seed(spark, d) -> DataFrame:
    role = F.when(F.col("day") >= fx.first_test(spark, d), "test").otherwise("dev").alias("role")
    n = F.col("n")
    return fx.per_day_seed(spark, d).groupBy("method", "ord", "seed", role).agg(
        me.weighted_mean(F.col("log_loss"), n).alias("log_loss"), me.weighted_mean(F.col("brier"), n).alias("brier"))


@query("consolidated_table", "A15", sql("""
SELECT method, round(avg(log_loss), 6) AS log_loss_mean, round(stddev_samp(log_loss) / sqrt(count(*)), 6) AS log_loss_se,
       round(avg(brier), 6) AS brier_mean, round(stddev_samp(brier) / sqrt(count(*)), 6) AS brier_se, count(*) AS n_seeds
FROM pseed WHERE role = 'test' GROUP BY method""", *SEEDED, CONSOL))
def consolidated_table(spark, d) -> DataFrame:
    out = _per_seed(spark, d).filter("role = 'test'").groupBy("method").agg(
        *me.mean_and_se("log_loss"), *me.mean_and_se("brier"), F.count("*").alias("n_seeds"))
    return out.select("method", *[r6(c) for c in out.columns if c.endswith(("_mean", "_se"))], "n_seeds")


ABLATION_LABELS = [("full ladder", "uniform5"), ("no short windows", "roll14"), ("long history only", "expanding")]


@query("ablation_table", "A16", sql("""
SELECT l.label, role, round(avg(log_loss), 6) AS log_loss_mean,
       round(stddev_samp(log_loss) / sqrt(count(*)), 6) AS log_loss_se
FROM pseed JOIN (VALUES ('full ladder', 'uniform5'), ('no short windows', 'roll14'),
                        ('long history only', 'expanding')) l(label, method) USING (method)
GROUP BY l.label, role""", *SEEDED, CONSOL))
def ablation_table(spark, d) -> DataFrame:
    labels = literal_rows(spark, ABLATION_LABELS, "label string, method string")
    out = _per_seed(spark, d).join(F.broadcast(labels), "method").groupBy("label", "role").agg(
        *me.mean_and_se("log_loss"))
    return out.select("label", "role", r6("log_loss_mean"), r6("log_loss_se"))


@query("count_distinct_windows", "A17", sql("""
SELECT count(DISTINCT method) AS n_windows, count(*) AS days FROM (
  SELECT day, method, row_number() OVER (PARTITION BY day ORDER BY round(log_loss, 10), ord) AS r
  FROM pd WHERE day >= (SELECT test_from FROM day_bounds) AND method <> 'uniform5') WHERE r = 1""", *METH))
def count_distinct_windows(spark, d) -> DataFrame:
    losses = fx.day_losses(fx.expert_tally(spark, d)).filter(F.col("day") >= fx.first_test(spark, d))
    best = dg.best_per(losses, ["day"])
    return best.agg(F.countDistinct("expert").alias("n_windows"), F.count("*").alias("days"))


@query("calibration_in_large", "A18", sql("""
SELECT method, day, round(avg(p), 6) AS mean_p, round(avg(click), 6) AS rate,
       round(abs(avg(p) - avg(click)), 6) AS gap FROM rec GROUP BY method, day""", *BASE, REC))
def calibration_in_large(spark, d) -> DataFrame:
    p, y = F.sum(F.col("n") * F.col("p")) / F.sum("n"), F.sum("clicks") / F.sum("n")
    return fx.method_tally(spark, d).groupBy("method", "day").agg(
        r6(p, "mean_p"), r6(y, "rate"), r6(F.abs(p - y), "gap"))


@query("margin_stats", "A19", sql(f"""
SELECT method, day, round(avg({lg('p')}) FILTER (click = 1) - avg({lg('p')}) FILTER (click = 0), 6) AS margin,
       round(max(abs({lg('p')})), 6) AS max_abs_logit, round(avg(abs({lg('p')})), 6) AS mean_abs_logit
FROM rec GROUP BY method, day""", *BASE, REC))
def margin_stats(spark, d) -> DataFrame:
    out = me.logit_margins(fx.method_tally(spark, d), ["method", "day"])
    return out.select("method", "day", r6("margin"), r6("max_abs_logit"), r6("mean_abs_logit"))


@query("share_beats_controls", "A20", sql("""
SELECT count(*) AS days, round(avg(CASE WHEN m < a THEN 1.0 ELSE 0.0 END), 6) AS beats_first,
       round(avg(CASE WHEN m < b THEN 1.0 ELSE 0.0 END), 6) AS beats_second,
       round(avg(CASE WHEN m < a AND m < b THEN 1.0 ELSE 0.0 END), 6) AS beats_both
FROM (SELECT day, max(log_loss) FILTER (method = 'uniform5') AS m, max(log_loss) FILTER (method = 'expanding') AS a,
             max(log_loss) FILTER (method = 'roll7') AS b FROM pd WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY day)""", *METH))
def share_beats_controls(spark, d) -> DataFrame:
    wide = fx.per_day(spark, d).filter(F.col("day") >= fx.first_test(spark, d)).groupBy("day").pivot(
        "method", ["uniform5", "expanding", "roll7"]).agg(F.max("log_loss"))
    a, b = F.col("uniform5") < F.col("expanding"), F.col("uniform5") < F.col("roll7")

    def share(c):
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    return wide.agg(F.count("*").alias("days"), r6(share(a), "beats_first"), r6(share(b), "beats_second"),
                    r6(share(a & b), "beats_both"))


@query("stationary_downside", "A21", sql("""
SELECT method, round(l - (SELECT min(l) FROM t WHERE method <> 'uniform5'), 6) AS downside FROM t""",
    *METH, "t AS (SELECT method, sum(log_loss * n) / sum(n) AS l FROM pd WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY method)"))
def stationary_downside(spark, d) -> DataFrame:
    per = fx.per_day(spark, d).filter(F.col("day") >= fx.first_test(spark, d)).groupBy("method").agg(
        me.weighted_mean(F.col("log_loss"), F.col("n")).alias("l"))
    best = per.filter(F.col("method").isin(hi.WINDOW_ORDER)).agg(F.min("l").alias("best"))
    return per.crossJoin(best).select("method", r6(F.col("l") - F.col("best"), "downside"))


@query("merge_results", "A22", sql(f"""
SELECT 'roll3' AS method, day, count(*) AS n, round(avg({ll('click', 'm.roll3')}), 6) AS log_loss
FROM imp i JOIN mrates m USING (campaign, day) WHERE day >= 4 GROUP BY day
UNION ALL
SELECT method, day, n, round(log_loss, 6) FROM pd WHERE method <> 'roll3'""", *METH, rates(True, "mrates")))
def merge_results(spark, d) -> DataFrame:
    """A rerun of one method on matured labels replaces its rows in the earlier table."""
    old = fx.per_day(spark, d).select("method", "day", "n", "log_loss")
    rerun = fx.expert_tally(spark, d, matured=True).filter(F.col("expert") == "roll3")
    new = me.mean_losses(rerun.withColumnRenamed("expert", "method"), ["method", "day"]).select(*old.columns)
    return me.keep_last(old, new, ["method", "day"]).withColumn("log_loss", F.round("log_loss", 6))
