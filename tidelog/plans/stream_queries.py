"""Queries: streaming jobs over the log, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scoring as sc
from tidelog.operators import calibrate as ca
from tidelog.operators import history as hi
from tidelog.plans import fixtures as fx
from tidelog.plans import within_queries as wq
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, IMP, ll, sql
from tidelog.session import attach
from tidelog.sources import logs
from tidelog.streaming import jobs

BLOCK, DELAY = wq.BLOCK, wq.DELAY


def impressions(spark, d) -> DataFrame:
    """The event log, one file or a folder of parts, as a stream of impressions in event order."""
    return jobs.replay(logs.events_log(spark, d).select("row_id", "day", "sec", "click", "campaign", "cat1", "grp"))


def frozen(spark, d) -> DataFrame:
    """Stream joined to the predictions frozen at the start of each day (a static table)."""
    rate = hi.rate_bank(fx.cells(spark, d), ["campaign"]).select("campaign", "day", *hi.WINDOW_ORDER)
    return attach(fx.eligible(impressions(spark, d)), rate, ["campaign", "day"], "inner")


def _z(spark, d) -> DataFrame:
    rows = frozen(spark, d)
    return rows.select("at", "row_id", "day", "sec", "click", F.round(sc.logit(F.col("expanding")), 12).alias("z"))


@query("stream_scan", "S11", sql("SELECT row_id, day, sec, click, campaign FROM imp", IMP))
def stream_scan(spark, d) -> DataFrame:
    """The raw files as they lie, in the order they came."""
    path = f"{d}/events.parquet"
    raw = jobs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=64)
    return jobs.drain(logs.impressions(raw).select("row_id", "day", "sec", "click", "campaign"), "append")


@query("stream_block_tokens", "ST1", sql(f"""
SELECT day, block, count(*) AS n, round(avg(click), 6) AS mean_y, round(avg(q), 6) AS mean_q, round(avg(click - q), 6) AS mean_r,
       round(avg({ll('click', 'q')}), 6) AS mean_loss FROM bq GROUP BY day, block""", *BASE, wq.q_cte()))
def stream_block_tokens(spark, d) -> DataFrame:
    rows = frozen(spark, d).withColumn("q", F.col("expanding"))
    out = jobs.drain(jobs.windowed_tokens(rows, BLOCK), "update", ["day", "block"])
    return out.select("day", "block", "n", r6("mean_y"), r6("mean_q"), r6("mean_r"), r6("mean_loss"))


@query("stream_ops", "ST2", sql("""
SELECT day, block, round(a, 6) AS a, round(b, 6) AS b, CAST(step AS INTEGER) AS step FROM path WHERE cfg = 'platt'""",
    *BASE, wq.q_cte(), *wq.ops_ctes(wq.OPS_CONFIGS), recursive=True))
def stream_ops(spark, d) -> DataFrame:
    out = jobs.drain(jobs.ops_blocks(_z(spark, d), wq.OPS_CONFIGS[1], BLOCK, DELAY), "append")
    return out.select("day", "block", r6("a"), r6("b"), "step")


@query("ops_impression", "C2")
def ops_impression(spark, d) -> DataFrame:
    """One calibration step per matured label."""
    out = jobs.drain(jobs.ops_events(_z(spark, d), ca.OpsConfig("event", eta0=0.02), DELAY), "append")
    return out.select("row_id", "day", r6("p"))


@query("stream_ons", "ST3", sql("""
SELECT day, block, round(a, 6) AS a, round(b, 6) AS b, CAST(step AS INTEGER) AS step FROM opath WHERE cfg = 'short'""",
    *BASE, wq.q_cte(), *wq.ons_ctes(wq.ONS_CONFIGS), recursive=True))
def stream_ons(spark, d) -> DataFrame:
    rows = _z(spark, d).withColumn("stream", F.lit("log"))
    out = jobs.drain(jobs.ons_blocks(rows, wq.ONS_CONFIGS[0], BLOCK, DELAY), "append")
    return out.select("day", "block", r6("a"), r6("b"), "step")


@query("stream_fixed_share", "ST4", sql("""
SELECT day, block, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, CAST(n_updates AS INTEGER) AS n_updates
FROM wpath WHERE cfg = 'anchored'""", *BASE, *wq.share_ctes(wq._ANCHOR_LOSS), recursive=True))
def stream_fixed_share(spark, d) -> DataFrame:
    rows = frozen(spark, d).select(F.lit("log").alias("stream"), "at", "row_id", "day", "sec", "click",
                                   *[F.col(e).alias(f"p{i}") for i, e in enumerate(wq.ANCHORS)])
    out = jobs.drain(jobs.share_blocks(rows, wq.SHARE_CONFIGS[0], BLOCK, DELAY), "append")
    return out.select("day", "block", r6("w0"), r6("w1"), r6("w2"), "n_updates")


@query("stream_day_metrics", "ST5", sql(f"""
SELECT day, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks, round(avg({ll('click', 'expanding')}), 6) AS log_loss,
       round(avg((expanding - click) * (expanding - click)), 6) AS brier FROM bank GROUP BY day""", *BASE))
def stream_day_metrics(spark, d) -> DataFrame:
    rows = frozen(spark, d).withColumn("q", F.col("expanding"))
    out = jobs.drain(jobs.windowed_day_metrics(rows), "update", ["day"])
    return out.select("day", "n", "clicks", r6("log_loss"), r6("brier"))
