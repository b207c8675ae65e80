"""Event-log sources. Every source returns the same impression schema."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import timeaxis as ta

EVENTS_ORIGIN = "2024-01-01"
MONTH_ORIGIN_YEAR = 1995

# Columns known before the bid; anything else is an outcome and must not reach a feature.
PREBID_COLUMNS = ["row_id", "day", "sec", "campaign", "cat1", "grp"]
OUTCOME_COLUMNS = ["click", "conversion", "attribution", "cost", "cpo"]

DELIMITED_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("campaign", T.LongType()),
    T.StructField("click", T.IntegerType()),
    T.StructField("cat1", T.LongType()),
    T.StructField("cost", T.DoubleType()),
])


def events_log(spark: SparkSession, folder: str, first_day: int | None = None,
               last_day: int | None = None) -> DataFrame:
    """Second-resolution impression log with auction columns.

    Day bounds are stated on the raw timestamp, so they reach the Parquet scan.
    """
    raw = spark.read.parquet(f"{folder}/events.parquet")
    if first_day is not None:
        raw = raw.filter(F.col("ts") >= _midnight(first_day, raw))
    if last_day is not None:
        raw = raw.filter(F.col("ts") < _midnight(last_day + 1, raw))
    return impressions(raw)


def _midnight(day: int, raw: DataFrame):
    at = datetime.fromisoformat(EVENTS_ORIGIN) + timedelta(days=day)
    return F.lit(str(at)).cast(raw.schema["ts"].dataType)


def impressions(raw: DataFrame) -> DataFrame:
    """Raw events (batch or stream) as impressions."""
    ts = F.col("ts")
    clicked = F.col("event_type").isin("click", "purchase")
    bought = (F.col("event_type") == "purchase").cast("int")
    campaign = F.col("user_id") % 10
    return raw.select(
        F.col("event_id").alias("row_id"),
        ts,
        ta.day_index(ts, EVENTS_ORIGIN).alias("day"),
        ta.sec_in_day(ts).alias("sec"),
        clicked.cast("int").alias("click"),
        bought.alias("conversion"),
        bought.alias("attribution"),
        F.greatest(F.col("value"), F.lit(0.01)).alias("cost"),
        F.lit(0.2).alias("cpo"),
        campaign.alias("campaign"),
        (F.get_json_object("props", "$.k").cast("long") % 8).alias("cat1"),
        F.when(campaign < 5, "A").otherwise("B").alias("grp"),
    )


def lineitem_log(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse log: one block per month, no clock within the day."""
    raw = spark.read.parquet(f"{folder}/lineitem.parquet")
    ship = F.col("l_shipdate")
    return raw.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        ship.alias("ts"),
        ((F.year(ship) - MONTH_ORIGIN_YEAR) * 12 + F.month(ship) - 1).alias("day"),
        F.lit(0).alias("sec"),
        (F.col("l_returnflag") == "R").cast("int").alias("click"),
        F.lit(0).alias("conversion"),
        F.lit(0).alias("attribution"),
        F.col("l_extendedprice").alias("cost"),
        F.lit(0.2).alias("cpo"),
        (F.col("l_suppkey") % 10).alias("campaign"),
        F.col("l_linenumber").cast("long").alias("cat1"),
        F.when(F.col("l_suppkey") % 10 < 5, "A").otherwise("B").alias("grp"),
    )


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events": events_log,
    "lineitem": lineitem_log,
}


def source(name: str, spark: SparkSession, folder: str) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; have {sorted(SOURCES)}")
    return SOURCES[name](spark, folder)


def delimited_log(spark: SparkSession, paths: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """Text log in one or several parts (gzip is read as is); schema declared, columns pruned."""
    raw = (spark.read.schema(DELIMITED_SCHEMA).option("sep", sep).option("header", header)
           .option("enforceSchema", "false").csv(paths))
    return raw.select("campaign", "click", "cat1", "cost",
                      ta.epoch_day(F.col("timestamp")).alias("day"),
                      (F.col("timestamp") % ta.SECONDS_PER_DAY).cast("int").alias("sec"))


def prebid(df: DataFrame) -> DataFrame:
    """Allow-list projection: only columns known before the bid survive."""
    return df.select(*[c for c in PREBID_COLUMNS if c in df.columns])


def require_prebid(columns: list[str]) -> None:
    leaked = sorted(set(columns) & set(OUTCOME_COLUMNS))
    if leaked:
        raise ValueError(f"outcome columns used as features: {leaked}")


def arrival_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Lay rows out by day and sort them by arrival inside each partition; a big day spans several."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "day", "sec", "row_id").sortWithinPartitions("day", "sec", "row_id")
