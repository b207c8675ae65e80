"""Queries: scalar functions, hashing, context and gate inputs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.operators import features as fe
from tidelog.operators import history as hi
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, EXPERTS, IMP, LONG, METH, lg, ll, sg, sql

TOKEN_COLUMNS = ["campaign", "cat1", "grp"]
CONTEXT_COLUMNS = ["campaign", "cat1"]
SKETCH_DIM = 8


@query("hash_features", "F1")
def hash_features(spark, d) -> DataFrame:
    """Hashed one-hot vector of the context tokens, shown as its non-zero positions."""
    rows = fe.hashed_vector(fx.imp(spark, d).select("row_id", *TOKEN_COLUMNS), TOKEN_COLUMNS, width=256)
    marked = F.transform(vector_to_array("features"), lambda x, i: F.when(x != 0, i))
    return rows.select("row_id", F.filter(marked, lambda i: i.isNotNull()).alias("positions"))


def _md5_tail(col: str, mod: int) -> str:
    return f"CAST(('0x' || substr(md5('{col}=' || {col}), 18, 15))::BIGINT % {mod} AS INTEGER)"


@query("hash_indices", "F2", sql(f"""
SELECT row_id, {_md5_tail('campaign', 65536)} AS campaign_code, {_md5_tail('cat1', 65536)} AS cat1_code
FROM imp""", IMP))
def hash_indices(spark, d) -> DataFrame:
    rows = fx.imp(spark, d).withColumn("codes", fe.hash_codes(CONTEXT_COLUMNS, 2 ** 16))
    return rows.select("row_id", F.col("codes")[0].alias("campaign_code"), F.col("codes")[1].alias("cat1_code"))


@query("norm_context", "F3", sql("""
SELECT row_id, round(campaign / (SELECT max(campaign) FROM imp)::DOUBLE, 6) AS ctx_campaign,
       round(cat1 / (SELECT max(cat1) FROM imp)::DOUBLE, 6) AS ctx_cat1 FROM imp""", IMP))
def norm_context(spark, d) -> DataFrame:
    rows = fe.max_normalised(fx.imp(spark, d).select("row_id", *CONTEXT_COLUMNS), CONTEXT_COLUMNS)
    return rows.select("row_id", r6("ctx_campaign"), r6("ctx_cat1"))


@query("factorize_context", "F4", """
WITH v AS (SELECT 'event_type' AS col, event_type AS value FROM events
           UNION ALL SELECT 'props', props FROM events),
c AS (SELECT col, value, count(*) AS n, dense_rank() OVER (PARTITION BY col ORDER BY value) - 1 AS code
      FROM v GROUP BY col, value)
SELECT col, value, n, code, round(code / max(code) OVER (PARTITION BY col)::DOUBLE, 6) AS norm FROM c""")
def factorize_context(spark, d) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    parts = [fe.sorted_codes(raw, c).withColumn("col", F.lit(c)) for c in ("event_type", "props")]
    return parts[0].unionByName(parts[1]).select("col", "value", "n", "code", r6("norm"))


def sketch_cte(m: int, source: str = "imp", name: str = "sk") -> str:
    """CTE with the unit-length signed sketch of every row of ``source``: row_id, c0..c(m-1)."""
    dims = []
    for j in range(m):
        terms = [f"CASE WHEN ('0x' || substr(md5('{c}=' || {c}), 18, 15))::BIGINT % {m} = {j} THEN "
                 f"(CASE WHEN ('0x' || substr(md5('{c}=' || {c}), 1, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) "
                 f"ELSE 0.0 END" for c in TOKEN_COLUMNS]
        dims.append(f"({' + '.join(terms)})::DOUBLE AS r{j}")
    norm = "sqrt(" + " + ".join(f"r{j} * r{j}" for j in range(m)) + ")"
    cols = ", ".join(f"r{j} / CASE WHEN nrm > 0 THEN nrm ELSE 1.0 END AS c{j}" for j in range(m))
    return (f"{name} AS (SELECT row_id, {cols} FROM (SELECT *, {norm} AS nrm FROM "
            f"(SELECT row_id, {', '.join(dims)} FROM {source})))")


@query("context_sketch", "F5", sql(
    "SELECT row_id, " + ", ".join(f"round(c{j}, 6) AS c{j}" for j in range(SKETCH_DIM)) + " FROM sk",
    IMP, sketch_cte(SKETCH_DIM)))
def context_sketch(spark, d) -> DataFrame:
    rows = fx.imp(spark, d).select("row_id", fe.signed_sketch(TOKEN_COLUMNS, SKETCH_DIM))
    return rows.select("row_id", *[r6(F.col("sketch")[j], f"c{j}") for j in range(SKETCH_DIM)])


@query("logit_sigmoid", "F6", sql(f"""
SELECT row_id, round({lg('roll1')}, 6) AS z, round({sg('2 * ' + lg('roll1') + ' + 0.1')}, 6) AS p FROM bank""", *BASE))
def logit_sigmoid(spark, d) -> DataFrame:
    z = sc.logit(F.col("roll1"))
    return fx.bank_rows(spark, d).select("row_id", r6(z, "z"), r6(sc.sigmoid(2 * z + 0.1), "p"))


@query("sample_log_loss", "F7", sql(f"SELECT row_id, round({ll('click', 'roll7')}, 6) AS loss FROM bank", *BASE))
def sample_log_loss(spark, d) -> DataFrame:
    return fx.bank_rows(spark, d).select("row_id", r6(sc.log_loss(F.col("click"), F.col("roll7")), "loss"))


@query("phase_features", "F8", sql("""
SELECT DISTINCT day, round(CASE WHEN day < 7 THEN 0 ELSE sin(2 * pi() * day / 7) END, 6) AS sin_phase,
       round(CASE WHEN day < 7 THEN 0 ELSE cos(2 * pi() * day / 7) END, 6) AS cos_phase FROM imp""", IMP))
def phase_features(spark, d) -> DataFrame:
    """Position in a weekly cycle, neutral until one full cycle has been seen."""
    days = fx.imp(spark, d).select("day").distinct()
    s, c = sc.phase(F.col("day"), F.when(F.col("day") >= 7, F.lit(7)))
    return days.select("day", r6(s, "sin_phase"), r6(c, "cos_phase"))


PREV = f"""days AS (SELECT DISTINCT day FROM dl),
prevday AS (SELECT d.day, (SELECT max(e.day) FROM days e WHERE e.day < d.day) AS prev FROM days d),
recent AS (SELECT p.day, {', '.join(f"coalesce(max(l.loss) FILTER (l.expert = '{e}'), 0) AS recent_{e}" for e in EXPERTS)}
           FROM prevday p LEFT JOIN dl l ON l.day = p.prev GROUP BY p.day)"""


def _recent(spark, d) -> DataFrame:
    return fe.previous_day(fx.day_losses(fx.expert_tally(spark, d)), "expert", hi.WINDOW_ORDER)


@query("gate_features_2", "F9", sql("""
SELECT b.row_id, b.day, round(b.roll3, 6) AS roll3, round(b.expanding, 6) AS expanding,
       round(abs(b.roll3 - b.expanding), 6) AS abs_diff, round(b.roll3 - b.expanding, 6) AS diff,
       round(b.day / (SELECT last_day FROM day_bounds)::DOUBLE, 6) AS norm_t, round(recent_roll3, 6) AS recent_roll3,
       round(recent_expanding, 6) AS recent_expanding, round(b.campaign / 9.0::DOUBLE, 6) AS ctx_campaign,
       round(b.cat1 / 7.0::DOUBLE, 6) AS ctx_cat1
FROM bank b JOIN recent r ON r.day = b.day""", *LONG, PREV))
def gate_features_2(spark, d) -> DataFrame:
    rows = fe.max_normalised(fx.bank_rows(spark, d), CONTEXT_COLUMNS).select(
        "row_id", "day", "roll3", "expanding", "ctx_campaign", "ctx_cat1")
    out = fe.pair_features(rows, _recent(spark, d), hi.SHORT, hi.LONG, fx.last_day(spark, d))
    return out.select("row_id", "day", *[r6(c) for c in out.columns if c not in ("row_id", "day")])


_SPREAD = f"greatest({', '.join('b.' + e for e in EXPERTS)}) - least({', '.join('b.' + e for e in EXPERTS)})"


@query("gate_features_k", "F10", sql(f"""
SELECT b.row_id, b.day, {', '.join(f'round(b.{e}, 6) AS {e}' for e in EXPERTS)},
       round({_SPREAD}, 6) AS spread, round(b.day / (SELECT last_day FROM day_bounds)::DOUBLE, 6) AS norm_t,
       {', '.join(f'round(recent_{e}, 6) AS recent_{e}' for e in EXPERTS)},
       round(b.campaign / 9.0::DOUBLE, 6) AS ctx_campaign, round(b.cat1 / 7.0::DOUBLE, 6) AS ctx_cat1
FROM bank b JOIN recent r ON r.day = b.day""", *LONG, PREV))
def gate_features_k(spark, d) -> DataFrame:
    rows = fe.max_normalised(fx.bank_rows(spark, d), CONTEXT_COLUMNS).select(
        "row_id", "day", *hi.WINDOW_ORDER, "ctx_campaign", "ctx_cat1")
    out = fe.multi_features(rows, _recent(spark, d), hi.WINDOW_ORDER, fx.last_day(spark, d))
    return out.select("row_id", "day", *[r6(c) for c in out.columns if c not in ("row_id", "day")])


META = ["roll3", "expanding", "uniform5"]


@query("meta_features", "F11", sql(f"""
SELECT b.row_id, b.day, {', '.join(f'round(b.{e}, 6) AS {e}' for e in META)},
       round(greatest(b.roll3, b.expanding, b.uniform5) - least(b.roll3, b.expanding, b.uniform5), 6) AS spread,
       round(b.day / (SELECT last_day FROM day_bounds)::DOUBLE, 6) AS norm_t,
       {', '.join(f"round(coalesce((SELECT log_loss FROM pd WHERE method = '{e}' AND pd.day = b.day - 1), 0), 6) AS recent_{e}" for e in META)}
FROM bank b""", *METH))
def meta_features(spark, d) -> DataFrame:
    """Inputs of the stacking gate: three finished methods as its experts."""
    losses = fx.day_losses(fx.method_tally(spark, d).filter(F.col("method").isin(META)), by="method")
    recent = fe.previous_day(losses, "method", META)
    rows = hi.uniform_mix(fx.bank_rows(spark, d), hi.WINDOW_ORDER).select("row_id", "day", *META)
    out = fe.multi_features(rows, recent, META, fx.last_day(spark, d))
    return out.select("row_id", "day", *[r6(c) for c in out.columns if c not in ("row_id", "day")])


@query("persist_state", "F12", sql(f"""
SELECT r.day, {', '.join(f'round(recent_{e}, 6) AS recent_{e}' for e in EXPERTS)},
  round(coalesce((SELECT avg(abs(roll3 - expanding)) FROM bank b WHERE b.day = p.prev), 0), 6) AS recent_disagreement,
  round(coalesce((SELECT avg(click) FROM bank b WHERE b.day = p.prev), 0), 6) AS recent_ctr,
  round(coalesce((SELECT max(abs(x.loss - y.loss)) FROM dl x JOIN dl y ON y.expert = x.expert
                  AND y.day = (SELECT max(day) FROM days WHERE day < p.prev) WHERE x.day = p.prev), 0), 6) AS loss_jump,
  round(CASE WHEN p.prev IS NULL THEN 0 ELSE r.day / (SELECT last_day FROM day_bounds)::DOUBLE END, 6) AS norm_t
FROM recent r JOIN prevday p ON p.day = r.day""", *LONG, PREV))
def persist_state(spark, d) -> DataFrame:
    out = fe.persistence_state(fx.wide_cells(spark, d), fx.day_losses(fx.expert_tally(spark, d)), "expert",
                               hi.WINDOW_ORDER, hi.SHORT, hi.LONG, fx.last_day(spark, d))
    return out.select("day", *[r6(c) for c in out.columns if c != "day"])


def _sign(side: str, i: int, j: int) -> str:
    return f"(CASE WHEN ('0x' || substr(md5('{side}:{i}:{j}'), 1, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE"


def _phi_sql(cross: int) -> str:
    a = [lg("b.expanding"), "(b.sec / 86400.0::DOUBLE)"]
    s = ["r.recent_roll3", "r.recent_expanding"]
    raw = ["1.0::DOUBLE", *a, *s]
    for j in range(cross):
        left = " + ".join(f"{x} * {_sign('a', i, j)}" for i, x in enumerate(a))
        right = " + ".join(f"{x} * {_sign('s', i, j)}" for i, x in enumerate(s))
        raw.append(f"({left}) * ({right})")
    inner = ", ".join(f"{x} AS f{i}" for i, x in enumerate(raw))
    norm = "greatest(1.0, sqrt(" + " + ".join(f"f{i} * f{i}" for i in range(len(raw))) + "))"
    out = ", ".join(f"round(f{i} / nrm, 6) AS phi{i}" for i in range(len(raw)))
    return sql(f"""SELECT row_id, {out} FROM (SELECT *, {norm} AS nrm FROM (
      SELECT b.row_id, {inner} FROM bank b JOIN recent r ON r.day = b.day))""", *LONG, PREV)


@query("cross_phi", "F13", _phi_sql(2))
def cross_phi(spark, d) -> DataFrame:
    """Bounded context-by-history features with a signed-hash cross term."""
    recent = _recent(spark, d).select("day", "recent_roll3", "recent_expanding")
    rows = fx.bank_rows(spark, d).join(recent, "day")
    a = [sc.logit(F.col("expanding")), F.col("sec") / 86400.0]
    s = [F.col("recent_roll3"), F.col("recent_expanding")]
    phi = fe.interaction(a, s, 2)
    return rows.select("row_id", phi.alias("phi")).select(
        "row_id", *[r6(F.col("phi")[i], f"phi{i}") for i in range(7)])


@query("ema_half_life", "F14", sql("""
SELECT day, round(exp(-ln(2.0) / 1 * ((SELECT last_day FROM day_bounds) - day)), 6) AS w1, round(exp(-ln(2.0) / 3 * ((SELECT last_day FROM day_bounds) - day)), 6) AS w3,
       round(exp(-ln(2.0) / 7 * ((SELECT last_day FROM day_bounds) - day)), 6) AS w7, round(avg(click) * pow(2, -1.0 / 3), 6) AS kept,
       round(avg(click) * (1 - pow(2, -900.0 / 57600)), 6) AS shared
FROM imp GROUP BY day""", IMP))
def ema_half_life(spark, d) -> DataFrame:
    """Decay weights by age, the per-step keep factor, and the per-block share rate, on daily click rates."""
    daily = fx.imp(spark, d).groupBy("day").agg(F.avg("click").alias("ctr"))
    age = fx.last_day(spark, d) - F.col("day")
    return daily.select("day", *[r6(sc.age_weight(age, h), f"w{h}") for h in (1, 3, 7)],
                        r6(F.col("ctr") * sc.keep_per_step(3), "kept"),
                        r6(F.col("ctr") * sc.share_rate(900, 16 * 3600), "shared"))
