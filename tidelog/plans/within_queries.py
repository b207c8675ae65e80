"""Queries: within-day calibration, block history and delayed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.functions import timeaxis as ta
from tidelog.operators import blocks as bl
from tidelog.operators import calibrate as ca
from tidelog.operators import features as fe
from tidelog.plans import fixtures as fx
from tidelog.plans.feature_queries import TOKEN_COLUMNS, sketch_cte
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, lg, ll, sg, sql

BLOCK, DELAY = 3600, 1800
M = 2  # sketch dimension of the tokens


def q_rows(spark, d, p: str = "expanding") -> DataFrame:
    return fx.bank_rows(spark, d).withColumn("q", F.col(p))


def stats(spark, d, p: str = "expanding", block: int = BLOCK, delay: int = DELAY) -> DataFrame:
    return ca.block_stats(q_rows(spark, d, p).select("day", "sec", "click", "q"), block, delay)


def q_cte(p: str = "expanding") -> str:
    return f"""bq AS (SELECT row_id, day, sec, click, campaign, cat1, grp, {p} AS q, CAST(least(sec // {BLOCK}, 23) AS INTEGER) AS block,
  CAST(ceil((sec + {DELAY}) / {BLOCK}.0::DOUBLE) AS BIGINT) - 1 AS upd, round({lg(p)}, 12) AS z FROM bank)"""


OPS_CONFIGS = [ca.OpsConfig("intercept"), ca.OpsConfig("platt", eta0=0.2, platt=True),
               ca.OpsConfig("constant", eta0=0.05, decay_steps=False)]
CARRY_CONFIGS = [ca.OpsConfig("reset"), ca.OpsConfig("half", carry=0.5), ca.OpsConfig("full", carry=1.0, platt=True)]


def ops_ctes(configs: list[ca.OpsConfig]) -> list[str]:
    rows = ", ".join(f"('{c.name}', {c.radius}::DOUBLE, {c.eta0}::DOUBLE, {c.decay_steps}, {c.platt}, {c.carry}::DOUBLE)"
                     for c in configs)
    resid = f"{sg('p.a * f.zs[i] + p.b')} - f.ys[i]"
    return [
        "nb AS (SELECT day, block, row_number() OVER (PARTITION BY day ORDER BY block) AS i FROM (SELECT DISTINCT day, block FROM bq))",
        """lab AS (SELECT q.day, q.z, q.click, (SELECT min(n.i) FROM nb n WHERE n.day = q.day AND n.block >= q.upd) AS i FROM bq q)""",
        """fresh AS (SELECT n.day, n.block, n.i, row_number() OVER (ORDER BY n.day, n.block) AS g, list(l.z) AS zs, list(l.click) AS ys,
            count(l.z) AS m FROM nb n LEFT JOIN lab l ON l.day = n.day AND l.i = n.i GROUP BY n.day, n.block, n.i)""",
        f"cfgs AS (SELECT * FROM (VALUES {rows}) c(cfg, radius, eta0, slow, platt, carry))",
        f"""ops AS (
  SELECT c.*, CAST(1 AS BIGINT) AS g, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, CAST(0 AS BIGINT) AS step FROM cfgs c
  UNION ALL
  SELECT cfg, radius, eta0, slow, platt, carry, g + 1, CASE WHEN newday THEN 1.0 ELSE a2 END,
         CASE WHEN newday THEN greatest(least(carry * b2, radius), -radius) ELSE b2 END, CASE WHEN newday THEN 0 ELSE s2 END
  FROM (SELECT *, CASE WHEN m > 0 THEN greatest(least(b - eta * gb, radius), -radius) ELSE b END AS b2,
               CASE WHEN m > 0 AND platt THEN greatest(least(a - eta * ga, 5.0), 0.2) ELSE a END AS a2
        FROM (SELECT p.*, f.m, n.i = 1 AS newday, p.step + CASE WHEN f.m > 0 THEN 1 ELSE 0 END AS s2,
                CASE WHEN slow THEN eta0 / sqrt(p.step + 1) ELSE eta0 END AS eta,
                CASE WHEN f.m > 0 THEN list_sum(list_transform(range(1, f.m + 1), lambda i: {resid})) / f.m END AS gb,
                CASE WHEN f.m > 0 THEN list_sum(list_transform(range(1, f.m + 1), lambda i: ({resid}) * f.zs[i])) / f.m END AS ga
              FROM ops p JOIN fresh f ON f.g = p.g JOIN fresh n ON n.g = p.g + 1)))""",
        "path AS (SELECT o.cfg, f.day, f.block, o.a, o.b, o.step, f.m FROM ops o JOIN fresh f ON f.g = o.g)"]


_PATH_OUT = """SELECT cfg, day, block, round(a, 6) AS a, round(b, 6) AS b, CAST(step AS INTEGER) AS step,
  CAST(m AS DOUBLE) AS n_matured FROM path"""


@query("ops_block", "C1", sql(_PATH_OUT, *BASE, q_cte(), *ops_ctes(OPS_CONFIGS), recursive=True))
def ops_block(spark, d) -> DataFrame:
    path = ca.ops_path(stats(spark, d), OPS_CONFIGS)
    return path.select("cfg", "day", "block", r6("a"), r6("b"), "step", "n_matured")


@query("ops_block_predictions", "C1", sql(f"""
SELECT b.row_id, p.cfg, round({sg('p.a * ' + lg('b.q') + ' + p.b')}, 6) AS p
FROM bq b JOIN path p ON p.day = b.day AND p.block = b.block""", *BASE, q_cte(), *ops_ctes(OPS_CONFIGS), recursive=True))
def ops_block_predictions(spark, d) -> DataFrame:
    """Row predictions: the log joined to the state used in its block."""
    path = ca.ops_path(stats(spark, d), OPS_CONFIGS)
    out = ca.apply_path(q_rows(spark, d).select("row_id", "day", "sec", "q"), path, BLOCK)
    return out.select("row_id", "cfg", r6("p"))


@query("carryover", "C3", sql(_PATH_OUT, *BASE, q_cte(), *ops_ctes(CARRY_CONFIGS), recursive=True))
def carryover(spark, d) -> DataFrame:
    path = ca.ops_path(stats(spark, d), CARRY_CONFIGS)
    return path.select("cfg", "day", "block", r6("a"), r6("b"), "step", "n_matured")


@query("chronology_placebo", "C4", sql("""
SELECT t.row_id, t.day, t.sec, f.row_id AS from_row, f.click, round(f.expanding, 6) AS q
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sec, row_id) AS r FROM bank) t
JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ('0x' || substr(md5('7:' || row_id), 1, 8))::BIGINT, row_id) AS r
      FROM bank) f ON f.day = t.day AND f.r = t.r""", *BASE))
def chronology_placebo(spark, d) -> DataFrame:
    rows = q_rows(spark, d).select("row_id", "day", "sec", "click", "q")
    out = ca.shuffle_within_day(rows, ["click", "q"], seed=7)
    return out.select("row_id", "day", "sec", "from_row", "click", r6("q"))


def _newton(keys: str, table: str, rounds: int = 12) -> str:
    p = sg("zs[i] + b")
    return f"""nt AS (
  SELECT {keys}, zs, ys, m, 0 AS it, 0.0::DOUBLE AS b FROM {table}
  UNION ALL SELECT {keys}, zs, ys, m, it + 1, greatest(least(b
    - list_sum(list_transform(range(1, m + 1), lambda i: {p} - ys[i]))
    / (list_sum(list_transform(range(1, m + 1), lambda i: {p} * (1 - {p}))) + 1e-12 * m), 1.0), -1.0)
  FROM nt WHERE it < {rounds})"""


ORACLE_B = [q_cte(), "od AS (SELECT day, list(z) AS zs, list(click) AS ys, count(*) AS m FROM bq GROUP BY day)",
            _newton("day", "od"), "ob AS (SELECT day, b FROM nt WHERE it = 12)"]


def z_tally(spark, d, p: str = "expanding", **extra) -> DataFrame:
    rows = q_rows(spark, d, p).withColumns({"z": F.round(sc.logit(F.col("q")), 12), **extra})
    return rows.groupBy("day", *extra, "z").agg(F.count("*").alias("n"), F.sum("click").alias("clicks"))


def oracle_losses(spark, d, p: str = "expanding") -> DataFrame:
    """(day, b, l_long, l_oracle): frozen loss and loss at the best fixed intercept."""
    tally = z_tally(spark, d, p)
    best = ca.newton_intercepts(tally, ["day"])
    n, k, z = F.col("n"), F.col("clicks"), F.col("z")
    return tally.join(best, "day").groupBy("day", "b").agg(
        (F.sum(sc.tally_loss(n, k, sc.sigmoid(z))) / F.sum("n")).alias("l_long"),
        (F.sum(sc.tally_loss(n, k, sc.sigmoid(z + F.col("b")))) / F.sum("n")).alias("l_oracle"))


@query("oracle_intercept", "C5", sql(f"""
SELECT o.day, round(o.b, 6) AS b, round(avg({ll('q.click', sg('q.z + o.b'))}), 6) AS loss
FROM ob o JOIN bq q ON q.day = o.day GROUP BY o.day, o.b""", *BASE, *ORACLE_B, recursive=True))
def oracle_intercept(spark, d) -> DataFrame:
    return oracle_losses(spark, d).select("day", r6("b"), r6("l_oracle", "loss"))


SLOTS = [q_cte(), """sh AS (SELECT d.day, q.block AS slot, list(q.z) AS zs, list(q.click) AS ys, count(*) AS m
  FROM (SELECT DISTINCT day FROM bq) d JOIN bq q ON q.day < d.day GROUP BY d.day, q.block
  HAVING count(*) >= 50 AND sum(click) > 0 AND sum(click) < count(*))""", _newton("day, slot", "sh"),
         "sb AS (SELECT day, slot, b FROM nt WHERE it = 12)"]


def _slot_path(spark, d) -> tuple[DataFrame, DataFrame]:
    tally = z_tally(spark, d, slot=ta.block_of(F.col("sec"), 3600))
    days = tally.select("day").distinct()
    return tally, ca.slot_intercepts(tally, days)


@query("time_of_day", "C6", sql(f"""
SELECT q.day, q.block AS slot, round(coalesce(s.b, 0), 6) AS b, round(avg({ll('click', sg('z + coalesce(s.b, 0)'))}), 6) AS loss
FROM bq q LEFT JOIN sb s ON s.day = q.day AND s.slot = q.block GROUP BY q.day, q.block, s.b""",
    *BASE, *SLOTS, recursive=True))
def time_of_day(spark, d) -> DataFrame:
    """Hourly intercepts learned on earlier days only, and the loss they give."""
    tally, fitted = _slot_path(spark, d)
    b = F.coalesce(F.col("b"), F.lit(0.0))
    joined = tally.join(fitted, ["day", "slot"], "left").withColumn("b", b)
    return joined.groupBy("day", "slot", "b").agg(
        r6(F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), sc.sigmoid(F.col("z") + F.col("b")))) / F.sum("n"), "loss")) \
        .withColumn("b", F.round("b", 6))


ONS_CONFIGS = [ca.OnsConfig("short", half_life_h=4.0), ca.OnsConfig("long", half_life_h=16.0)]


def ons_ctes(configs: list[ca.OnsConfig]) -> list[str]:
    rows = ", ".join(f"('{c.name}', pow(2.0, -{BLOCK} / ({c.half_life_h} * 3600.0)))" for c in configs)
    resid = f"{sg('o.t0 * zs[i] + o.t1')} - ys[i]"
    return [
        f"""blk AS (SELECT day, block, list(z) AS zs, list(click) AS ys, count(*) AS m, row_number() OVER (ORDER BY day, block) AS r,
            CAST(day AS BIGINT) * 86400 + block * {BLOCK} AS start, CAST(day AS BIGINT) * 86400 + (block + 1) * {BLOCK} + {DELAY} AS ready
            FROM bq GROUP BY day, block)""",
        f"ocfg AS (SELECT * FROM (VALUES {rows}) c(cfg, gamma))",
        f"""ons AS (
  SELECT cfg, gamma, CAST(0 AS BIGINT) AS r, 1.0::DOUBLE AS t0, 0.0::DOUBLE AS t1, 0.01::DOUBLE AS a00, 0.0::DOUBLE AS a01, 0.01::DOUBLE AS a11 FROM ocfg
  UNION ALL
  SELECT cfg, gamma, r + 1, greatest(least(t0 - ((b11 + 1e-12) * g0 - b01 * g1) / det, 5.0), 0.2),
         greatest(least(t1 - (-b01 * g0 + (b00 + 1e-12) * g1) / det, 0.25), -0.25), b00, b01, b11
  FROM (SELECT *, (b00 + 1e-12) * (b11 + 1e-12) - b01 * b01 AS det FROM (
    SELECT *, gamma * a00 + g0 * g0 + (1 - gamma) * 0.01 AS b00, gamma * a01 + g0 * g1 AS b01,
           gamma * a11 + g1 * g1 + (1 - gamma) * 0.01 AS b11 FROM (
      SELECT o.*, list_sum(list_transform(range(1, k.m + 1), lambda i: ({resid}) * zs[i])) / k.m AS g0,
             list_sum(list_transform(range(1, k.m + 1), lambda i: {resid})) / k.m AS g1
      FROM ons o JOIN blk k ON k.r = o.r + 1))))""",
        """opath AS (SELECT o.cfg, b.day, b.block, o.t0 AS a, o.t1 AS b, o.r AS step FROM blk b
            JOIN ons o ON o.r = (SELECT count(*) FROM blk x WHERE x.ready <= b.start))"""]


@query("ons_stream", "C7", sql("""
SELECT cfg, day, block, round(a, 6) AS a, round(b, 6) AS b, CAST(step AS INTEGER) AS step FROM opath""",
    *BASE, q_cte(), *ons_ctes(ONS_CONFIGS), recursive=True))
def ons_stream(spark, d) -> DataFrame:
    path = ca.ons_path(stats(spark, d), ONS_CONFIGS, BLOCK, DELAY)
    return path.select("cfg", "day", "block", r6("a"), r6("b"), "step")


@query("ons_stream_reset", "C7")
def ons_stream_reset(spark, d) -> DataFrame:
    """Daily-reset and slope-free variants of the Newton replay."""
    configs = [ca.OnsConfig("reset", reset_daily=True), ca.OnsConfig("no_slope", learn_slope=False)]
    path = ca.ons_path(stats(spark, d), configs, BLOCK, DELAY)
    return path.select("cfg", "day", "block", r6("a"), r6("b"), "step", "clipped")


ANCHORS = ["expanding", "roll3", "roll14"]
SHARE_CONFIGS = [ca.ShareConfig("anchored"), ca.ShareConfig("eager", eta=50.0, half_life_h=4.0, adaptive_mass=1.0),
                 ca.ShareConfig("anchor_only", adaptive_mass=0.0)]


def share_ctes(losses: str) -> list[str]:
    """``losses``: body of a CTE with day, block and mean block losses l0, l1, l2."""
    rows = ", ".join(
        f"('{c.name}', {c.eta}::DOUBLE, {sc.share_rate(BLOCK, c.half_life_h * 3600)!r}::DOUBLE, "
        + ", ".join(f"{p}::DOUBLE" for p in c.prior()) + ")" for c in SHARE_CONFIGS)
    lo = "least(l0, l1, l2)"
    g = [f"w{i} * exp(-eta * (l{i} - {lo}))" for i in range(3)]
    return [f"bls AS ({losses})",
            f"""sb AS (SELECT *, row_number() OVER (ORDER BY day, block) AS r, CAST(day AS BIGINT) * 86400 + block * {BLOCK} AS start,
                CAST(day AS BIGINT) * 86400 + (block + 1) * {BLOCK} + {DELAY} AS ready FROM bls)""",
            f"scfg AS (SELECT * FROM (VALUES {rows}) c(cfg, eta, rate, p0, p1, p2))",
            f"""shr AS (SELECT *, CAST(0 AS BIGINT) AS r, p0 AS w0, p1 AS w1, p2 AS w2 FROM scfg
  UNION ALL SELECT cfg, eta, rate, p0, p1, p2, s.r + 1,
    {', '.join(f"(1 - rate) * ({g[i]}) / ({' + '.join(g)}) + rate * p{i}" for i in range(3))}
  FROM shr s JOIN sb b ON b.r = s.r + 1)""",
            """wpath AS (SELECT s.cfg, b.day, b.block, s.w0, s.w1, s.w2, s.r AS n_updates FROM sb b
               JOIN shr s ON s.r = (SELECT count(*) FROM sb x WHERE x.ready <= b.start))"""]


_ANCHOR_LOSS = f"""SELECT day, CAST(least(sec // {BLOCK}, 23) AS INTEGER) AS block, """ + ", ".join(
    f"avg({ll('click', e)}) AS l{i}" for i, e in enumerate(ANCHORS)) + " FROM bank GROUP BY ALL"


def anchor_losses(spark, d) -> DataFrame:
    """Block losses of three prediction streams, straight from the log."""
    rows = fx.bank_rows(spark, d).withColumn("block", ta.block_of(F.col("sec"), BLOCK))
    return rows.groupBy("day", "block").agg(
        *[F.avg(sc.log_loss(F.col("click"), F.col(e))).alias(f"l{i}") for i, e in enumerate(ANCHORS)])


@query("anchored_share", "C8", sql("""
SELECT cfg, day, block, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, CAST(n_updates AS INTEGER) AS n_updates
FROM wpath""", *BASE, *share_ctes(_ANCHOR_LOSS), recursive=True))
def anchored_share(spark, d) -> DataFrame:
    path = ca.share_path(anchor_losses(spark, d), SHARE_CONFIGS, BLOCK, DELAY)
    return path.select("cfg", "day", "block", r6("w0"), r6("w1"), r6("w2"), "n_updates")


@query("weight_path_summary", "W14", sql("""
SELECT cfg, count(*) FILTER (w0 >= w1 AND w0 >= w2) AS led0, count(*) FILTER (w1 > w0 AND w1 >= w2) AS led1,
  count(*) FILTER (w2 > w0 AND w2 > w1) AS led2, round(min(least(w0, w1, w2)), 6) AS w_min,
  round(max(greatest(w0, w1, w2)), 6) AS w_max, round(max_by(w0, day * 100 + block), 6) AS final0,
  round(max_by(w1, day * 100 + block), 6) AS final1, round(max_by(w2, day * 100 + block), 6) AS final2,
  CAST(max(n_updates) AS INTEGER) AS n_updates
FROM (SELECT cfg, day, block, n_updates, round(w0, 9) AS w0, round(w1, 9) AS w1, round(w2, 9) AS w2 FROM wpath) GROUP BY cfg""",
    *BASE, *share_ctes(_ANCHOR_LOSS), recursive=True))
def weight_path_summary(spark, d) -> DataFrame:
    path = ca.share_path(anchor_losses(spark, d), SHARE_CONFIGS, BLOCK, DELAY)
    path = path.withColumns({w: F.round(w, 9) for w in ("w0", "w1", "w2")})
    out = ca.weight_path_summary(path)
    return out.select("cfg", "led0", "led1", "led2", r6("w_min"), r6("w_max"),
                      r6("final0"), r6("final1"), r6("final2"), "n_updates")


def token_rows(spark, d, p: str = "expanding", m: int = M) -> DataFrame:
    return q_rows(spark, d, p).select("row_id", "day", "sec", "click", "q", fe.signed_sketch(TOKEN_COLUMNS, m))


def tokens(spark, d, block: int = BLOCK, m: int = M) -> DataFrame:
    return bl.block_tokens(token_rows(spark, d, m=m), block, m)


TOKEN_NAMES = [*bl.TOKEN_FIELDS, *[f"c{j}" for j in range(M)], *[f"rc{j}" for j in range(M)]]
TOK = [*BASE, q_cte(), sketch_cte(M, "bank"), f"""tok AS (
  SELECT d.day, CAST(b.k AS INTEGER) AS block, coalesce(ln(1 + count(q.row_id)), 0) AS log1p_n, coalesce(avg(click), 0) AS mean_y,
    coalesce(avg(q), 0) AS mean_q, coalesce(avg({lg('q')}), 0) AS mean_logit, coalesce(avg(click - q), 0) AS mean_r,
    coalesce(avg(abs(click - q)), 0) AS mean_abs_r, coalesce(avg({ll('click', 'q')}), 0) AS mean_loss,
    {', '.join(f'coalesce(avg(c{j}), 0) AS c{j}' for j in range(M))}, {', '.join(f'coalesce(avg((click - q) * c{j}), 0) AS rc{j}' for j in range(M))}
  FROM (SELECT DISTINCT day FROM bq) d CROSS JOIN range(24) b(k) LEFT JOIN bq q ON q.day = d.day AND q.block = b.k
  LEFT JOIN sk ON sk.row_id = q.row_id GROUP BY d.day, b.k)"""]
_TOK_OUT = ", ".join(f"round({n}, 6) AS {n}" for n in TOKEN_NAMES)


@query("block_tokens", "C10", sql(f"SELECT day, block, {_TOK_OUT} FROM tok", *TOK))
def block_tokens(spark, d) -> DataFrame:
    return tokens(spark, d).select("day", "block", *[r6(F.col("u")[i], n) for i, n in enumerate(TOKEN_NAMES)])


SHOWN = ["mean_y", "mean_r"]


def _ewma_sql() -> list[str]:
    steps, first = [], []
    for f in SHOWN:
        for i, h in enumerate(bl.HALF_LIVES, 1):
            keep = repr(0.5 ** (1.0 / h))
            first.append(f"{f} AS {f}_e{i}")
            steps.append(f"(1.0 - {keep}::DOUBLE) * t.{f} + {keep}::DOUBLE * s.{f}_e{i}")
    return [f"""sm AS (SELECT day, block, {', '.join(first)} FROM tok WHERE block = 0
      UNION ALL SELECT t.day, t.block, {', '.join(steps)} FROM sm s JOIN tok t ON t.day = s.day AND t.block = s.block + 1)""",
            "summ AS (SELECT s.*, " + ", ".join(
                f"t.{f} AS {f}_u, coalesce(v.{f}, 0) AS {f}_prev, t.{f} - coalesce(v.{f}, 0) AS {f}_diff" for f in SHOWN)
            + " FROM sm s JOIN tok t ON t.day = s.day AND t.block = s.block LEFT JOIN tok v ON v.day = s.day AND v.block = s.block - 1)"]


_SUM_COLS = [f"{f}_{c}" for f in SHOWN for c in ("u", "prev", "e1", "e2", "e3", "diff")]


def _shown(summary: DataFrame) -> DataFrame:
    cols = []
    for f in SHOWN:
        i = TOKEN_NAMES.index(f)
        cols += [F.col(c)[i].alias(f"{f}_{c}") for c in ("u", "prev", "e1", "e2", "e3", "diff")]
    return summary.select("day", "block", *cols)


@query("ewma_summary", "C11", sql(
    f"SELECT day, block, {', '.join(f'round({c}, 6) AS {c}' for c in _SUM_COLS)} FROM summ", *TOK, *_ewma_sql(), recursive=True))
def ewma_summary(spark, d) -> DataFrame:
    out = _shown(bl.causal_summary(tokens(spark, d)))
    return out.select("day", "block", *[r6(c) for c in _SUM_COLS])


@query("asof_history", "C12", sql(f"""
SELECT q.row_id, CAST(coalesce(k.k, -1) AS INTEGER) AS k_avail, {', '.join(f'round(coalesce(s.{c}, 0), 6) AS {c}' for c in _SUM_COLS)}
FROM bq q LEFT JOIN LATERAL (SELECT max(b.k) AS k FROM range(24) b(k) WHERE (b.k + 1) * {BLOCK} + {DELAY} <= q.sec) k ON true
LEFT JOIN summ s ON s.day = q.day AND s.block = k.k""", *TOK, *_ewma_sql(), recursive=True))
def asof_history(spark, d) -> DataFrame:
    history = _shown(bl.causal_summary(tokens(spark, d)))
    out = bl.as_of(q_rows(spark, d).select("row_id", "day", "sec"), history, BLOCK, DELAY)
    return out.select("row_id", "k_avail", *[r6(F.coalesce(F.col(c), F.lit(0.0)), c) for c in _SUM_COLS])


@query("history_window", "C13", sql(f"""
SELECT q.row_id, count(t.block) AS filled, round(coalesce(sum(t.mean_r), 0), 6) AS sum_r,
       round(coalesce(min_by(t.mean_q, t.block), 0), 6) AS oldest_q
FROM bq q LEFT JOIN LATERAL (SELECT max(b.k) AS k FROM range(24) b(k) WHERE (b.k + 1) * {BLOCK} + {DELAY} <= q.sec) k ON true
LEFT JOIN tok t ON t.day = q.day AND t.block > k.k - 4 AND t.block <= k.k GROUP BY q.row_id""", *TOK))
def history_window(spark, d) -> DataFrame:
    """The last four matured tokens of every row, shown by their count, residual sum and oldest prediction mean."""
    window = bl.recent_window(tokens(spark, d), 4)
    r, q = TOKEN_NAMES.index("mean_r"), TOKEN_NAMES.index("mean_q")
    out = bl.as_of(q_rows(spark, d).select("row_id", "day", "sec"), window, BLOCK, DELAY)
    total = F.aggregate("window", F.lit(0.0), lambda acc, u: acc + u[r])
    return out.select("row_id", F.coalesce("filled", F.lit(0)).cast("long").alias("filled"),
                      r6(F.coalesce(total, F.lit(0.0)), "sum_r"),
                      r6(F.coalesce(F.col("window")[0][q], F.lit(0.0)), "oldest_q"))


_KEEP = {"no_history": [], "no_residual_sketch": [n for n in TOKEN_NAMES if not n.startswith("rc")],
         "label_free_history": [n for n in TOKEN_NAMES if not n.startswith("rc") and n not in bl.LABEL_FIELDS]}


def _ablation_sql() -> str:
    parts = [f"SELECT '{k}' AS ablation, day, block, " + ", ".join(
        f"round({n}, 6) AS {n}" if n in keep else f"0.0::DOUBLE AS {n}" for n in TOKEN_NAMES) + " FROM tok"
        for k, keep in _KEEP.items()]
    parts.append(f"""SELECT 'shuffled_chronology', day, CAST(row_number() OVER (PARTITION BY day ORDER BY
      ('0x' || substr(md5('0:' || day || ':' || block), 1, 8))::BIGINT, block) - 1 AS INTEGER), {_TOK_OUT} FROM tok""")
    return sql(" UNION ALL ".join(parts), *TOK)


@query("token_ablations", "C16", _ablation_sql())
def token_ablations(spark, d) -> DataFrame:
    base = tokens(spark, d)
    out = None
    for kind in [*_KEEP, "shuffled_chronology"]:
        part = bl.ablate(base, kind, M).select(
            F.lit(kind).alias("ablation"), "day", "block", *[r6(F.col("u")[i], n) for i, n in enumerate(TOKEN_NAMES)])
        out = part if out is None else out.unionByName(part)
    return out


SUITE = {"expanding": "expanding", "rolling_3": "roll3", "rolling_7": "roll7", "equal_ensemble": "uniform5"}


@query("method_suite", "C18", sql(f"""
SELECT method, day, round(loss, 6) AS loss FROM (
  SELECT CASE method WHEN 'roll3' THEN 'rolling_3' WHEN 'roll7' THEN 'rolling_7' WHEN 'uniform5' THEN 'equal_ensemble' ELSE method END AS method,
         day, avg({ll('click', 'p')}) AS loss FROM (SELECT b.*, e.method, CASE e.method WHEN 'roll3' THEN roll3 WHEN 'roll7' THEN roll7
           WHEN 'uniform5' THEN uniform5 ELSE expanding END AS p FROM bank b CROSS JOIN (VALUES ('roll3'), ('roll7'), ('uniform5'), ('expanding')) e(method))
         GROUP BY method, day
  UNION ALL SELECT 'short_only', b.day, avg({ll('b.click', sg('p.a * b.z + p.b'))}) FROM bq b JOIN path p ON p.day = b.day AND p.block = b.block
    WHERE p.cfg = 'intercept' GROUP BY b.day
  UNION ALL SELECT 'online_platt', b.day, avg({ll('b.click', sg('p.a * b.z + p.b'))}) FROM bq b JOIN path p ON p.day = b.day AND p.block = b.block
    WHERE p.cfg = 'platt' GROUP BY b.day
  UNION ALL SELECT 'oracle_intercept', q.day, avg({ll('q.click', sg('q.z + o.b'))}) FROM ob o JOIN bq q ON q.day = o.day GROUP BY q.day
  UNION ALL SELECT 'time_of_day', q.day, avg({ll('click', sg('z + coalesce(s.b, 0)'))}) FROM bq q
    LEFT JOIN (SELECT day, slot, b FROM nt2 WHERE it = 12) s ON s.day = q.day AND s.slot = q.block GROUP BY q.day)""",
    *BASE, *ORACLE_B, *ops_ctes(OPS_CONFIGS), SLOTS[1], SLOTS[2].replace("nt AS", "nt2 AS").replace("FROM nt WHERE", "FROM nt2 WHERE"),
    recursive=True))
def method_suite(spark, d) -> DataFrame:
    """The named baseline suite on one frozen prediction, as one table of daily losses."""
    plain = fx.per_day(spark, d).filter(F.col("method").isin(list(SUITE.values())))
    names = F.create_map(*[F.lit(x) for k, v in SUITE.items() for x in (v, k)])
    plain = plain.select(names[F.col("method")].alias("method"), "day", F.col("log_loss").alias("loss"))
    st = stats(spark, d)
    cal = ca.day_losses(ca.scored_blocks(st, ca.ops_path(st, OPS_CONFIGS)), ["cfg"])
    label = F.when(F.col("cfg") == "intercept", "short_only").when(F.col("cfg") == "platt", "online_platt")
    cal = cal.select(label.alias("method"), "day", "loss").filter("method IS NOT NULL")
    best = oracle_losses(spark, d).select(F.lit("oracle_intercept").alias("method"), "day", F.col("l_oracle").alias("loss"))
    tally, fitted = _slot_path(spark, d)
    b = F.coalesce(F.col("b"), F.lit(0.0))
    slots = tally.join(fitted, ["day", "slot"], "left").groupBy("day").agg(
        (F.sum(sc.tally_loss(F.col("n"), F.col("clicks"), sc.sigmoid(F.col("z") + b))) / F.sum("n")).alias("loss"))
    slots = slots.select(F.lit("time_of_day").alias("method"), "day", "loss")
    out = plain.unionByName(cal).unionByName(best).unionByName(slots)
    return out.select("method", "day", r6("loss"))
