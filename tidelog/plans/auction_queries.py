"""Queries: auction replay on the test days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import auction as au
from tidelog.operators import history as hi
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, REC, SEEDED, sql
from tidelog.session import literal_rows

N = au.N_SCALES
FRACTIONS = [0.1, 0.25, 0.5]
AUCTION = ["row_id", "day", "click", "conversion", "attribution", "cost", "cpo"]


def bids(spark, d) -> DataFrame:
    """Test rows of every method with auction columns."""
    wide = hi.uniform_mix(fx.bank_rows(spark, d).filter(F.col("day") >= fx.first_test(spark, d)), hi.WINDOW_ORDER)
    return hi.long_bank(wide, fx.METHODS, AUCTION).withColumnRenamed("expert", "method").drop("ord")


def r4(c: str, name: str | None = None):
    return F.round(F.col(c), 4).alias(name or c)


BID = "bid AS (SELECT * FROM rec WHERE day >= (SELECT test_from FROM day_bounds))"


def frontier_ctes(table: str = "bid", key: str = "method", name: str = "fr") -> list[str]:
    keys = ", ".join(f"b.{k}" for k in key.split(", "))
    on = " AND ".join(f"s.{k} = b.{k}" for k in key.split(", "))
    return [f"""{name}q AS (SELECT {key}, greatest(quantile_cont(cost / greatest(p, 1e-12), 0.001), 1e-9) AS lo,
              greatest(quantile_cont(cost / greatest(p, 1e-12), 0.999), 1e-8) AS hi, count(*) AS n FROM {table} GROUP BY {key})""",
            f"{name}s AS (SELECT *, lo * pow(hi / lo, i / {N - 1}.0::DOUBLE) AS scale FROM {name}q CROSS JOIN range({N}) r(i))",
            f"""{name} AS (SELECT {keys}, s.i AS step, s.scale, s.n, coalesce(sum(b.cost) FILTER (s.scale * b.p >= b.cost), 0) AS spend,
              count(*) FILTER (s.scale * b.p >= b.cost) AS impressions,
              CAST(coalesce(sum(b.click) FILTER (s.scale * b.p >= b.cost), 0) AS BIGINT) AS clicks,
              CAST(coalesce(sum(b.conversion) FILTER (s.scale * b.p >= b.cost), 0) AS BIGINT) AS conversions,
              CAST(coalesce(sum(b.attribution) FILTER (s.scale * b.p >= b.cost), 0) AS BIGINT) AS attributed,
              coalesce(sum(b.cpo * b.conversion) FILTER (s.scale * b.p >= b.cost), 0) AS cpo_value
              FROM {table} b JOIN {name}s s ON {on} GROUP BY {keys}, s.i, s.scale, s.n)"""]


_FR = """CAST(step AS INTEGER) AS step, round(scale, 4) AS scale, round(spend, 4) AS spend, impressions, clicks, conversions, attributed,
  round(cpo_value, 4) AS cpo_value, round(impressions / n::DOUBLE, 6) AS win_rate"""


def _show_frontier(fr: DataFrame, keys: list[str]) -> DataFrame:
    return fr.select(*keys, F.col("step").cast("int").alias("step"), r4("scale"), r4("spend"), "impressions", "clicks",
                     "conversions", "attributed", r4("cpo_value"), r6("win_rate"))


@query("linear_frontier", "B1", sql(f"SELECT method, {_FR} FROM fr", *BASE, REC, BID, *frontier_ctes()))
def linear_frontier(spark, d) -> DataFrame:
    return _show_frontier(au.linear_frontier(bids(spark, d), ["method"]), ["method"])


RANK = """rk AS (SELECT *, sum(cost) OVER (PARTITION BY method, day ORDER BY p / greatest(cost, 1e-12) DESC, row_id) AS cum FROM bid),
al AS (SELECT method, sum(cost) * 0.25 AS budget, sum(cost) * 0.25 / count(DISTINCT day) AS allowance FROM bid GROUP BY method)"""


@query("paced_auction", "B2", sql("""
SELECT r.method, r.day, round(coalesce(sum(cost) FILTER (cum <= allowance), 0), 4) AS spend, count(*) FILTER (cum <= allowance) AS impressions,
  CAST(coalesce(sum(click) FILTER (cum <= allowance), 0) AS BIGINT) AS clicks,
  CAST(coalesce(sum(conversion) FILTER (cum <= allowance), 0) AS BIGINT) AS conversions,
  round(any_value(allowance) - coalesce(sum(cost) FILTER (cum <= allowance), 0), 8) AS allowance_after
FROM rk r JOIN al a ON a.method = r.method GROUP BY r.method, r.day""", *BASE, REC, BID, RANK))
def paced_auction(spark, d) -> DataFrame:
    rows = bids(spark, d)
    out = au.paced_auction(au.ranked_by_efficiency(rows, ["method"]), ["method"], au.daily_allowance(rows, ["method"], 0.25))
    return out.select("method", "day", r4("spend"), "impressions", "clicks", "conversions", F.round("allowance_after", 8).alias("allowance_after"))


@query("paced_auction_carry", "B2", sql("""
SELECT c.method, c.day, round(spent, 4) AS spend, (SELECT count(*) FROM rk r WHERE r.method = c.method AND r.day = c.day AND r.cum <= c.spent + 1e-9) AS impressions,
  CAST(coalesce((SELECT sum(click) FROM rk r WHERE r.method = c.method AND r.day = c.day AND r.cum <= c.spent + 1e-9), 0) AS BIGINT) AS clicks,
  round(left_over, 8) AS allowance_after
FROM cr c WHERE c.day >= (SELECT test_from FROM day_bounds)""", *BASE, REC, BID, RANK, """
cr AS (SELECT method, allowance, CAST(21 AS INTEGER) AS day, 0.0::DOUBLE AS spent, 0.0::DOUBLE AS left_over FROM al
  UNION ALL SELECT method, allowance, CAST(day + 1 AS INTEGER), spent, now - spent FROM (
    SELECT c.method, c.allowance, c.day, c.left_over + c.allowance AS now,
      coalesce((SELECT max(r.cum) FROM rk r WHERE r.method = c.method AND r.day = c.day + 1 AND r.cum <= c.left_over + c.allowance), 0) AS spent
    FROM cr c WHERE c.day < (SELECT last_day FROM day_bounds)))""", recursive=True))
def paced_auction_carry(spark, d) -> DataFrame:
    rows = bids(spark, d)
    out = au.paced_auction_carry(au.ranked_by_efficiency(rows, ["method"]), ["method"],
                                 au.daily_allowance(rows, ["method"], 0.25))
    return out.select("method", "day", r4("spend"), "impressions", "clicks", F.round("allowance_after", 8).alias("allowance_after"))


@query("outcome_sums", "B3", sql("""
SELECT day, round(sum(cost), 4) AS spend, count(*) AS impressions, CAST(sum(click) AS BIGINT) AS clicks,
  CAST(sum(conversion) AS BIGINT) AS conversions, CAST(sum(attribution) AS BIGINT) AS attributed,
  round(sum(cpo * conversion), 4) AS cpo_value FROM bank WHERE expanding * 30 >= cost GROUP BY day""", *BASE))
def outcome_sums(spark, d) -> DataFrame:
    """What bidding thirty times the long window's prediction would have won, per day."""
    won = fx.bank_rows(spark, d).filter(F.col("expanding") * 30 >= F.col("cost"))
    out = won.groupBy("day").agg(*au.outcome_sums())
    return out.select("day", r4("spend"), F.col("impressions").cast("long").alias("impressions"), "clicks", "conversions",
                      "attributed", r4("cpo_value"))


TARGETS = f"""tg AS (SELECT f.f AS fraction, f.f * (SELECT sum(cost) FROM bid WHERE method = 'expanding') AS target
  FROM (VALUES {', '.join(f'({f}::DOUBLE)' for f in FRACTIONS)}) f(f))"""
INTERP = """pt AS (SELECT method, spend, clicks, lead(spend) OVER w AS ns, lead(clicks) OVER w AS nc,
  min(spend) OVER (PARTITION BY method) AS first_s, first(clicks) OVER w AS first_c FROM fr
  WINDOW w AS (PARTITION BY method ORDER BY spend, step)),
att AS (SELECT g.method, t.fraction, t.target, CASE WHEN p.ns IS NULL THEN p.clicks ELSE p.clicks + (p.nc - p.clicks) / (p.ns - p.spend) * (t.target - p.spend) END AS v,
  p.spend AS lo, coalesce(p.ns, p.spend) AS hi, g.first_s, g.first_c
  FROM (SELECT method, any_value(first_s) AS first_s, min(first_c) AS first_c FROM pt GROUP BY method) g CROSS JOIN tg t
  LEFT JOIN pt p ON p.method = g.method AND p.spend <= t.target AND (p.ns IS NULL OR p.ns > t.target) AND (p.ns IS NULL OR p.ns > p.spend))"""


def _targets(spark, d) -> DataFrame:
    total = fx.imp(spark, d).filter(F.col("day") >= fx.first_test(spark, d)).agg(F.sum("cost").alias("_t"))
    fr = literal_rows(spark, [(f,) for f in FRACTIONS], "fraction double")
    return fr.crossJoin(total).select("fraction", (F.col("fraction") * F.col("_t")).alias("target"))


@query("matched_spend", "B4", sql("""
SELECT method, fraction, round(v, 4) AS clicks FROM att""", *BASE, REC, BID, *frontier_ctes(), TARGETS, INTERP))
def matched_spend(spark, d) -> DataFrame:
    """Clicks of each method at the same spend; null left of its frontier."""
    fr = au.linear_frontier(bids(spark, d), ["method"])
    out = au.value_at_spend(fr, ["method"], _targets(spark, d))
    return out.select("method", "fraction", r4("clicks_at", "clicks"))


@query("clicks_at_spend", "B5", sql("""
SELECT method, fraction, round(coalesce(v, first_c), 4) AS clicks, round(coalesce(lo, first_s), 4) AS lo, round(coalesce(hi, first_s), 4) AS hi
FROM att""", *BASE, REC, BID, *frontier_ctes(), TARGETS, INTERP))
def clicks_at_spend(spark, d) -> DataFrame:
    """The same with the ends clamped, and the frontier points that bracket the target."""
    fr = au.linear_frontier(bids(spark, d), ["method"])
    out = au.value_at_spend(fr, ["method"], _targets(spark, d), clamp_left=True)
    return out.select("method", "fraction", r4("clicks_at", "clicks"), r4("lo"), r4("hi"))


REFB = """refb AS (SELECT row_id, day, click, conversion, attribution, cost, cpo, 'perfect' AS bidder, click::DOUBLE AS p FROM one
  UNION ALL SELECT row_id, day, click, conversion, attribution, cost, cpo, 'no_skill', (SELECT avg(click) FROM one) FROM one
  UNION ALL SELECT a.row_id, a.day, a.click, a.conversion, a.attribution, a.cost, a.cpo, 'shuffled', b.p
    FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS r FROM one) a
    JOIN (SELECT p, row_number() OVER (ORDER BY ('0x' || substr(md5('0:' || row_id), 1, 8))::BIGINT, row_id) AS r FROM one) b ON b.r = a.r)"""


@query("reference_bidders", "B6", sql("""
SELECT bidder, CAST(step AS INTEGER) AS step, round(spend, 4) AS spend, impressions, clicks FROM fr""",
    *BASE, "one AS (SELECT *, expanding AS p FROM bank WHERE day >= (SELECT test_from FROM day_bounds))", REFB, *frontier_ctes("refb", "bidder")))
def reference_bidders(spark, d) -> DataFrame:
    one = bids(spark, d).filter(F.col("method") == "expanding").drop("method")
    fr = au.linear_frontier(au.reference_bidders(one), ["bidder"])
    return fr.select("bidder", F.col("step").cast("int").alias("step"), r4("spend"), "impressions", "clicks")


@query("bidding_eval", "B7", sql("""
SELECT a.method, a.fraction, round(coalesce(v, first_c), 4) AS clicks_matched, a.lo < a.target AND a.target < a.hi AS in_bracket,
  round(p.spend, 4) AS paced_spend, p.clicks AS paced_clicks, round(p.spend / p.total, 6) AS share_of_spend
FROM att a JOIN (SELECT r.method, t.fraction, sum(cost) AS total, sum(cost) FILTER (cum <= t.target / 8) AS spend,
    CAST(sum(click) FILTER (cum <= t.target / 8) AS BIGINT) AS clicks FROM rk r CROSS JOIN tg t GROUP BY r.method, t.fraction) p
  ON p.method = a.method AND p.fraction = a.fraction""", *BASE, REC, BID, RANK, *frontier_ctes(), TARGETS, INTERP))
def bidding_eval(spark, d) -> DataFrame:
    """Matched-spend clicks and the paced realisation of every method and budget."""
    rows = bids(spark, d)
    targets = _targets(spark, d)
    matched = au.value_at_spend(au.linear_frontier(rows, ["method"]), ["method"], targets, clamp_left=True)
    ranked = au.ranked_by_efficiency(rows, ["method"])
    days = rows.agg(F.countDistinct("day").alias("_days"))
    # a bid falls between two budgets; what a budget buys is summed over the brackets up to it
    limits = targets.crossJoin(days).agg(F.sort_array(F.collect_list(F.struct(
        (F.col("target") / F.col("_days")).alias("limit"), "fraction"))).alias("_limits"))  # one row
    below = F.size(F.filter("_limits", lambda b: b["limit"] < F.col("cum_cost")))
    brackets = ranked.crossJoin(F.broadcast(limits)).groupBy("method", below.alias("_at")).agg(
        F.sum("cost").alias("_cost"), F.sum("click").alias("_click"))
    budgets = limits.select(F.posexplode("_limits").alias("_i", "b")).select("_i", "b.fraction")
    won = F.col("_at") <= F.col("_i")
    paced = brackets.crossJoin(F.broadcast(budgets)).groupBy("method", "fraction").agg(
        F.sum("_cost").alias("_total"), F.sum(F.when(won, F.col("_cost"))).alias("_spend"),
        F.sum(F.when(won, F.col("_click"))).alias("paced_clicks"))
    return matched.join(paced, ["method", "fraction"]).select(
        "method", "fraction", r4("clicks_at", "clicks_matched"),
        ((F.col("lo") < F.col("target")) & (F.col("target") < F.col("hi"))).alias("in_bracket"),
        r4("_spend", "paced_spend"), "paced_clicks", r6(F.col("_spend") / F.col("_total"), "share_of_spend"))


SBID = "sbid AS (SELECT * FROM srec WHERE day >= (SELECT test_from FROM day_bounds) AND method IN ('expanding', 'uniform5'))"


@query("value_paired_table", "B8", sql("""
SELECT d.fraction, round(avg(d.u - d.e), 4) AS mean_gain, round(100 * (sum(d.u) / sum(d.e) - 1), 4) AS gain_pct,
       count(*) FILTER (round(d.u - d.e, 6) > 0) AS seeds_won, count(*) AS n_seeds FROM (
  SELECT seed, fraction, max(v) FILTER (method = 'uniform5') AS u, max(v) FILTER (method = 'expanding') AS e FROM sat GROUP BY seed, fraction) d
GROUP BY d.fraction""", *SEEDED, SBID, *frontier_ctes("sbid", "seed, method"),
    f"""stg AS (SELECT c.seed, f.f AS fraction, f.f * c.c AS target FROM (SELECT seed, sum(cost) AS c FROM simp WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY seed) c
      CROSS JOIN (VALUES {', '.join(f'({f}::DOUBLE)' for f in FRACTIONS)}) f(f))""",
    """spt AS (SELECT seed, method, spend, clicks, lead(spend) OVER w AS ns, lead(clicks) OVER w AS nc FROM fr
       WINDOW w AS (PARTITION BY seed, method ORDER BY spend, step))""",
    """sat AS (SELECT p.seed, p.method, t.fraction, CASE WHEN p.ns IS NULL THEN p.clicks ELSE p.clicks + (p.nc - p.clicks) / (p.ns - p.spend) * (t.target - p.spend) END AS v
       FROM spt p JOIN stg t ON t.seed = p.seed AND p.spend <= t.target AND (p.ns IS NULL OR (p.ns > t.target AND p.ns > p.spend)))"""))
def value_paired_table(spark, d) -> DataFrame:
    """Extra clicks of the equal mix over the long window at matched spend, paired by seed."""
    log = fx.seeded(fx.imp(spark, d))
    rate = hi.rate_bank(hi.cell_counts(log, ["seed", "campaign"]), ["seed", "campaign"])
    rate = rate.select("seed", "campaign", "day", *hi.WINDOW_ORDER)
    test = log.filter(F.col("day") >= fx.first_test(spark, d))
    wide = hi.uniform_mix(test.join(rate, ["seed", "campaign", "day"]), hi.WINDOW_ORDER)
    rows = hi.long_bank(wide, ["expanding", "uniform5"], ["seed", *AUCTION]).withColumnRenamed("expert", "method")
    fr = au.linear_frontier(rows, ["seed", "method"])
    total = test.groupBy("seed").agg(F.sum("cost").alias("_c"))
    goals = total.crossJoin(literal_rows(spark, [(f,) for f in FRACTIONS], "fraction double")).select(
        "seed", "fraction", (F.col("fraction") * F.col("_c")).alias("target"))
    at = au.value_at_spend(fr, ["seed", "method"], goals)
    wide = at.groupBy("seed", "fraction").pivot("method", ["expanding", "uniform5"]).agg(F.max("clicks_at"))
    gain = F.col("uniform5") - F.col("expanding")
    return wide.groupBy("fraction").agg(
        F.round(F.avg(gain), 4).alias("mean_gain"),
        F.round(100 * (F.sum("uniform5") / F.sum("expanding") - 1), 4).alias("gain_pct"),
        F.count_if(F.round(gain, 6) > 0).alias("seeds_won"), F.count("*").alias("n_seeds"))
