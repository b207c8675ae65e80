"""Queries: sources, sinks, sampling and derived time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import timeaxis as ta
from tidelog.operators import history as hi
from tidelog.operators import splits as sp
from tidelog.plans import fixtures as fx
from tidelog.plans.registry import query, r6
from tidelog.plans.sqlbase import BASE, IMP, METH, SEEDED, sql
from tidelog.session import ensure_checkpoint_dir, running_total
from tidelog.sources import logs, sinks


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


@query("scan_log", "S1", sql("SELECT row_id, day, sec, click, campaign, cat1 FROM imp", IMP))
def scan_log(spark, d) -> DataFrame:
    return fx.imp(spark, d).select("row_id", "day", "sec", "click", "campaign", "cat1")


_LINE = """line AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS row_id, l_shipdate AS ts,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS day,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS click, l_suppkey % 10 AS campaign,
         l_extendedprice AS cost
  FROM lineitem)"""


@query("scan_multi_part", "S2", sql("""
SELECT row_id, part, row_number() OVER (ORDER BY ts, part, row_id) AS position, click
FROM (SELECT CAST(row_id AS VARCHAR) AS row_id, ts, click, 'events' AS part FROM imp
      UNION ALL SELECT row_id, ts, click, 'lineitem' AS part FROM line)""", IMP, _LINE))
def scan_multi_part(spark, d) -> DataFrame:
    """Concatenate the parts of a log and restore one chronological stream with positions."""
    parts = [logs.source(s, spark, d).select(F.col("row_id").cast("string").alias("row_id"),
                                             F.col("ts").cast("timestamp").alias("ts"),
                                             "click", F.lit(s).alias("part")) for s in ("events", "lineitem")]
    stream = parts[0].unionByName(parts[1]).withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("ts"), F.col("part"), F.col("row_id")]
    return running_total(stream, [], order, {"position": "_one"}).select("row_id", "part", "position", "click")


@query("scan_arrival_order", "S3", sql("""
SELECT row_id, day, sec, row_number() OVER (PARTITION BY day ORDER BY sec, row_id) AS position FROM imp""", IMP))
def scan_arrival_order(spark, d) -> DataFrame:
    rows = logs.arrival_order(fx.imp(spark, d)).select("row_id", "day", "sec", F.lit(1).cast("long").alias("_one"))
    return running_total(rows, ["day"], [F.col("sec"), F.col("row_id")], {"position": "_one"}).drop("_one")


@query("scan_auction_log", "S4", sql("""
SELECT row_id, day, campaign, click, conversion, attribution, cost, cpo, round(expanding, 6) AS p
FROM bank""", *BASE))
def scan_auction_log(spark, d) -> DataFrame:
    """Auction columns of the log with the prediction joined by row id."""
    predictions = fx.bank_rows(spark, d).select("row_id", F.col("expanding").alias("p"))
    log = logs.events_log(spark, d).select("row_id", "day", "campaign", "click", "conversion", "attribution",
                                           "cost", "cpo")
    return log.join(predictions, "row_id").withColumn("p", F.round("p", 6))


@query("source_dispatch", "S5", sql("""
SELECT 'events' AS source, day, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks FROM imp GROUP BY day
UNION ALL
SELECT 'lineitem', day, count(*), CAST(sum(click) AS BIGINT) FROM line GROUP BY day""", IMP, _LINE))
def source_dispatch(spark, d) -> DataFrame:
    parts = [sp.day_axis(logs.source(s, spark, d)).withColumn("source", F.lit(s)) for s in logs.SOURCES]
    return parts[0].unionByName(parts[1]).select("source", "day", "n", "clicks")


@query("chunk_sample", "S6", sql("""
SELECT seed, day, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks FROM simp GROUP BY seed, day""", *SEEDED))
def chunk_sample(spark, d) -> DataFrame:
    return fx.seeded(fx.imp(spark, d)).groupBy("seed", "day").agg(
        F.count("*").alias("n"), F.sum("click").alias("clicks"))


_PD_OUT = "SELECT method, day, n, clicks, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM pd"


@query("sink_tables", "S7", sql(_PD_OUT, *METH))
def sink_tables(spark, d) -> DataFrame:
    """Per-day metrics written by method partition and read back."""
    path = scratch(spark, "per_day")
    sinks.write_partitions(fx.per_day(spark, d).drop("ord"), path, ["method"])
    return sinks.read_cells(spark, path).select("method", "day", "n", "clicks", r6("log_loss"), r6("brier"))


@query("sink_predictions", "S8", sql("""
SELECT day AS origin, seed, count(*) AS n, round(sum(expanding), 6) AS sum_p, CAST(0 AS BIGINT) AS misaligned
FROM sbank WHERE day >= (SELECT test_from FROM day_bounds) GROUP BY day, seed""", *SEEDED))
def sink_predictions(spark, d) -> DataFrame:
    """Predictions of the test origins by (origin, seed), reloaded and aligned row by row with the log."""
    log = fx.seeded(fx.imp(spark, d))
    rates = hi.rate_bank(hi.cell_counts(log, ["seed", "campaign"]), ["seed", "campaign"])
    scored = log.filter(F.col("day") >= fx.first_test(spark, d)).join(
        rates.select("seed", "campaign", "day", "expanding"), ["seed", "campaign", "day"])
    path = scratch(spark, "predictions")
    sinks.write_partitions(scored.select("row_id", F.col("day").alias("origin"), "seed",
                                         F.col("expanding").alias("p")), path, ["origin", "seed"])
    back = sinks.read_cells(spark, path).select("row_id", F.col("origin").cast("int").alias("origin"),
                                                F.col("seed").cast("int").alias("seed"), "p")
    key = F.concat_ws(":", "seed", "row_id").alias("key")
    bad = sinks.misaligned(back.select(key), log.filter(F.col("day") >= fx.first_test(spark, d)).select(key), "key")
    n_bad = bad.agg(F.count("*").alias("misaligned"))
    out = back.groupBy("origin", "seed").agg(F.count("*").alias("n"), r6(F.sum("p"), "sum_p"))
    return out.crossJoin(n_bad)


@query("bank_cache", "S9", sql("""
SELECT campaign, day, round(roll3, 6) AS roll3, round(expanding, 6) AS expanding FROM rates WHERE day >= 4""", *BASE))
def bank_cache(spark, d) -> DataFrame:
    """Bank table built on the first call, read on the second."""
    path = scratch(spark, "bank")
    for _ in range(2):
        table = sinks.build_on_miss(spark, path, lambda: fx.wide_cells(spark, d), ["day"])
    return table.select("campaign", F.col("day").cast("int").alias("day"), r6("roll3"), r6("expanding"))


@query("load_cells", "S10", sql("""
SELECT seed, method, count(*) AS days, round(avg(log_loss), 6) AS mean_loss FROM spd GROUP BY seed, method""",
                                *SEEDED))
def load_cells(spark, d) -> DataFrame:
    """Result folders by (seed, method) collected into one frame by partition discovery."""
    path = scratch(spark, "cells")
    sinks.write_partitions(fx.per_day_seed(spark, d).drop("ord"), path, ["seed", "method"])
    return sinks.read_cells(spark, path).groupBy(F.col("seed").cast("int").alias("seed"), "method").agg(
        F.count("*").alias("days"), r6(F.avg("log_loss"), "mean_loss"))


@query("day_index", "P1", sql("SELECT row_id, day FROM imp", IMP))
def day_index(spark, d) -> DataFrame:
    return fx.imp(spark, d).select("row_id", "day")


@query("sec_in_day", "P2", sql("SELECT row_id, sec, CAST(sec // 3600 * 3600 AS INTEGER) AS hour_sec FROM imp", IMP))
def sec_in_day(spark, d) -> DataFrame:
    return fx.imp(spark, d).select("row_id", "sec", (F.floor(F.col("sec") / 3600) * 3600).cast("int").alias("hour_sec"))


@query("time_block", "P3", sql("""
SELECT event_id AS row_id,
       (CAST(floor(epoch(ts)) AS BIGINT) // 3600
        - (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) // 3600 FROM events)) // 2 AS block
FROM events"""))
def time_block(spark, d) -> DataFrame:
    """Hour stamps YYMMDDHH to running two-hour blocks from the first hour of the log."""
    stamp = F.date_format("ts", "yyMMddHH").cast("long")
    rows = logs.events_log(spark, d).select("row_id", ta.hour_stamp_to_epoch_hours(stamp).alias("_h"))
    first = rows.agg(F.min("_h").alias("_h0"))
    return rows.crossJoin(first).select("row_id", F.floor((F.col("_h") - F.col("_h0")) / 2).alias("block"))


@query("block_of", "P4", sql("SELECT row_id, CAST(least(sec // 900, 95) AS INTEGER) AS block FROM imp", IMP))
def block_of(spark, d) -> DataFrame:
    return fx.imp(spark, d).select("row_id", ta.block_of(F.col("sec"), 900).alias("block"))


@query("last_available_block", "P5", sql("""
SELECT row_id, CAST(coalesce((SELECT max(k) FROM range(96) b(k) WHERE (k + 1) * 900 + 1800 <= sec), -1) AS INTEGER)
       AS k_avail FROM imp""", IMP))
def last_available_block(spark, d) -> DataFrame:
    return fx.imp(spark, d).select("row_id", ta.last_available_block(F.col("sec"), 900, 1800).alias("k_avail"))


@query("maturity_filter", "P6", sql("""
SELECT CAST(c.cutoff AS INTEGER) AS cutoff, count(*) AS usable, CAST(sum(click) AS BIGINT) AS clicks
FROM imp i JOIN range(1, 31) c(cutoff) ON CAST(i.day AS BIGINT) * 86400 + i.sec + 1800 <= c.cutoff * 86400
GROUP BY c.cutoff""", IMP))
def maturity_filter(spark, d) -> DataFrame:
    """Usable labels at every midnight: daily counts joined to the day axis, the log is read once.

    With a delay of at most a day, a day's early part is usable at the next
    midnight and its tail one midnight later.
    """
    rows = fx.imp(spark, d).withColumn("tail", ~ta.matured_by_midnight(F.col("sec")))
    counts = rows.groupBy("day", "tail").agg(F.count("*").alias("n"), F.sum("click").alias("k"))
    cut = counts.select((F.col("day") + 1).alias("cutoff")).distinct()
    from_day = F.col("day") + F.when(F.col("tail"), 2).otherwise(1)
    return counts.join(cut, from_day <= F.col("cutoff")).groupBy("cutoff").agg(
        F.sum("n").alias("usable"), F.sum("k").alias("clicks"))


@query("day_matured", "P7", sql("""
SELECT day, count(*) AS n, count(*) FILTER (sec <= 84600) AS matured FROM imp GROUP BY day""", IMP))
def day_matured(spark, d) -> DataFrame:
    return fx.imp(spark, d).groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(ta.matured_by_midnight(F.col("sec"))).alias("matured"))


@query("prebid_projection", "P8", sql("SELECT row_id, day, sec, campaign, cat1, grp FROM imp", IMP))
def prebid_projection(spark, d) -> DataFrame:
    out = logs.prebid(fx.imp(spark, d))
    logs.require_prebid(out.columns)
    return out


@query("group_split", "P9", sql("""
SELECT day, campaign < (SELECT count(DISTINCT campaign) // 2 FROM imp) AS in_group, count(*) AS n,
       CAST(sum(click) AS BIGINT) AS clicks FROM imp GROUP BY ALL""", IMP))
def group_split(spark, d) -> DataFrame:
    rows = fx.imp(spark, d)
    card = rows.agg(F.floor(F.countDistinct("campaign") / 2).alias("_half"))
    return rows.crossJoin(card).groupBy("day", (F.col("campaign") < F.col("_half")).alias("in_group")).agg(
        F.count("*").alias("n"), F.sum("click").alias("clicks"))


@query("day_slice", "P10", sql("SELECT row_id, sec, click FROM imp WHERE day = 12", IMP))
def day_slice(spark, d) -> DataFrame:
    return logs.events_log(spark, d, 12, 12).select("row_id", "sec", "click")


@query("day_role", "P11", sql("""
SELECT i.day, CASE WHEN i.day < 16 THEN 'train' WHEN i.day < 21 THEN 'dev' ELSE 'test' END AS role,
       count(*) AS n, round(avg(click), 6) AS ctr FROM imp i GROUP BY i.day""", IMP))
def day_role(spark, d) -> DataFrame:
    days = sp.day_axis(fx.cells(spark, d))
    return days.join(sp.three_way(days, warmup=4), "day").select(
        "day", "role", "n", r6(F.col("clicks") / F.col("n"), "ctr"))
