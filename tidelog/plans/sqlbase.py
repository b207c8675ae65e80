"""Shared WITH-clauses of the SQL twins, written from the definitions on row level."""

from __future__ import annotations

EXPERTS = ["roll1", "roll3", "roll7", "roll14", "expanding"]
LEN = {"roll1": 1, "roll3": 3, "roll7": 7, "roll14": 14, "expanding": 100000}


def ll(y: str, p: str, eps: str = "1e-12") -> str:
    c = f"greatest(least({p}, 1.0 - {eps}), {eps})"
    return f"(-(({y}) * ln({c}) + (1 - ({y})) * ln(1.0 - {c})))"


def lg(p: str) -> str:
    c = f"greatest(least({p}, 1.0 - 1e-5), 1e-5)"
    return f"ln({c} / (1.0 - {c}))"


def sg(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-greatest(least({z}, 30.0), -30.0))))"


IMP = """imp AS (
  SELECT event_id AS row_id, ts,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
         CAST(CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS INTEGER) AS sec,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS click,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversion,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS attribution,
         greatest(value, 0.01) AS cost, CAST(0.2 AS DOUBLE) AS cpo,
         user_id % 10 AS campaign,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS cat1,
         CASE WHEN user_id % 10 < 5 THEN 'A' ELSE 'B' END AS grp
  FROM events),
day_bounds AS (
  SELECT max(day) AS last_day, CAST(max(day) - greatest(1, round_even((max(day) - 3) * 0.3, 0)) + 1 AS INTEGER) AS test_from
  FROM imp)"""

CELLS = """cells AS (
  SELECT campaign, day, count(*) AS n, CAST(sum(click) AS BIGINT) AS k,
         count(*) FILTER (sec > 84600) AS n_tail,
         CAST(coalesce(sum(click) FILTER (sec > 84600), 0) AS BIGINT) AS k_tail
  FROM imp GROUP BY campaign, day)"""


def _rate(window: int, matured: bool) -> str:
    k, n = "h.k", "h.n"
    if matured:
        k = "(h.k - CASE WHEN h.day = c.day - 1 THEN h.k_tail ELSE 0 END)"
        n = "(h.n - CASE WHEN h.day = c.day - 1 THEN h.n_tail ELSE 0 END)"
    f = f"FILTER (h.day >= c.day - {window})"
    return f"(coalesce(sum({k}) {f}, 0) + 0.8::DOUBLE) / (coalesce(sum({n}) {f}, 0) + 2.0::DOUBLE)"


def rates(matured: bool = False, name: str = "rates") -> str:
    cols = ", ".join(f"{_rate(LEN[e], matured)} AS {e}" for e in EXPERTS)
    return f"""{name} AS (
  SELECT c.campaign, c.day, {cols}
  FROM cells c LEFT JOIN cells h ON h.campaign = c.campaign AND h.day < c.day
  GROUP BY c.campaign, c.day)"""


RATES = rates()
BANK = """bank AS (
  SELECT i.*, r.roll1, r.roll3, r.roll7, r.roll14, r.expanding,
         (r.roll1 + r.roll3 + r.roll7 + r.roll14 + r.expanding) / 5 AS uniform5
  FROM imp i JOIN rates r ON r.campaign = i.campaign AND r.day = i.day
  WHERE i.day >= 4)"""

_E = ", ".join(f"('{e}', {i})" for i, e in enumerate(EXPERTS))
_CASE = "CASE e.expert " + " ".join(f"WHEN '{e}' THEN b.{e}" for e in EXPERTS) + " END"
BANKL = f"""bankl AS (
  SELECT b.*, e.expert, e.ord, {_CASE} AS p
  FROM bank b CROSS JOIN (VALUES {_E}) e(expert, ord))"""
DL = f"""dl AS (
  SELECT day, expert, ord, count(*) AS n, avg({ll('click', 'p')}) AS loss,
         round(avg({ll('click', 'p')}), 10) AS rl
  FROM bankl GROUP BY day, expert, ord)"""

_M = ", ".join(f"('{e}', {i})" for i, e in enumerate([*EXPERTS, "uniform5"]))
_MCASE = "CASE e.method " + " ".join(f"WHEN '{e}' THEN b.{e}" for e in [*EXPERTS, "uniform5"]) + " END"
REC = f"""rec AS (
  SELECT b.*, e.method, e.ord, {_MCASE} AS p
  FROM bank b CROSS JOIN (VALUES {_M}) e(method, ord))"""
PD = f"""pd AS (
  SELECT method, ord, day, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks,
         avg({ll('click', 'p')}) AS log_loss, avg((p - click) * (p - click)) AS brier
  FROM rec GROUP BY method, ord, day)"""

BASE = [IMP, CELLS, RATES, BANK]
LONG = [*BASE, BANKL, DL]
METH = [*BASE, REC, PD]

SEED = f"""simp AS (
  SELECT i.*, s.seed FROM imp i CROSS JOIN (VALUES (0), (1), (2)) s(seed)
  WHERE ('0x' || substr(md5(s.seed || ':' || i.row_id), 1, 8))::BIGINT < CAST(floor(0.8 * 4294967296) AS BIGINT)),
scells AS (SELECT seed, campaign, day, count(*) AS n, CAST(sum(click) AS BIGINT) AS k
           FROM simp GROUP BY seed, campaign, day),
srates AS (
  SELECT c.seed, c.campaign, c.day, {', '.join(f"{_rate(LEN[e], False)} AS {e}" for e in EXPERTS)}
  FROM scells c LEFT JOIN scells h ON h.seed = c.seed AND h.campaign = c.campaign AND h.day < c.day
  GROUP BY c.seed, c.campaign, c.day),
sbank AS (
  SELECT i.*, r.roll1, r.roll3, r.roll7, r.roll14, r.expanding,
         (r.roll1 + r.roll3 + r.roll7 + r.roll14 + r.expanding) / 5 AS uniform5
  FROM simp i JOIN srates r ON r.seed = i.seed AND r.campaign = i.campaign AND r.day = i.day
  WHERE i.day >= 4),
srec AS (
  SELECT b.*, e.method, e.ord, {_MCASE} AS p
  FROM sbank b CROSS JOIN (VALUES {_M}) e(method, ord)),
spd AS (
  SELECT seed, method, ord, day, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks,
         avg({ll('click', 'p')}) AS log_loss, avg((p - click) * (p - click)) AS brier
  FROM srec GROUP BY seed, method, ord, day)"""
SEEDED = [IMP, SEED]


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
