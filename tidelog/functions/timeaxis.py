"""Column expressions on the time axis: days, seconds, blocks and label maturity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
LABEL_DELAY_SEC = 1_800


def day_index(ts: Column, origin: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit(origin).cast("date"))


def sec_in_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def epoch_day(seconds: Column) -> Column:
    return F.floor(seconds / SECONDS_PER_DAY).cast("int")


def hour_stamp_to_epoch_hours(stamp: Column) -> Column:
    """YYMMDDHH integer -> hours since 1970."""
    date = F.make_date((F.lit(2000) + F.floor(stamp / 1_000_000)).cast("int"),
                       (F.floor(stamp / 10_000) % 100).cast("int"),
                       (F.floor(stamp / 100) % 100).cast("int"))
    return F.datediff(date, F.lit("1970-01-01").cast("date")) * 24 + (stamp % 100)


def blocks_per_day(block_sec: int) -> int:
    return -(-SECONDS_PER_DAY // block_sec)


def block_of(sec: Column, block_sec: int) -> Column:
    return F.least(F.floor(sec / block_sec), F.lit(blocks_per_day(block_sec) - 1)).cast("int")


def last_available_block(sec: Column, block_sec: int, delay_sec: int) -> Column:
    """Latest block whose labels had all matured at ``sec``; -1 when there is none."""
    k = F.floor((sec - delay_sec) / block_sec) - 1
    return F.greatest(F.lit(-1), F.least(k, F.lit(blocks_per_day(block_sec) - 1))).cast("int")


def update_block(sec: Column, block_sec: int, delay_sec: int) -> Column:
    """First block whose end is at or after the label's maturity (may lie past midnight)."""
    return (F.ceil((sec + delay_sec) / block_sec) - 1).cast("int")


def usable_by(day: Column, sec: Column, cutoff_day: Column, delay_sec: int = LABEL_DELAY_SEC) -> Column:
    """True when the label has matured by the start of ``cutoff_day``."""
    return (day.cast("long") * SECONDS_PER_DAY + sec + delay_sec) <= cutoff_day.cast("long") * SECONDS_PER_DAY


def matured_by_midnight(sec: Column, delay_sec: int = LABEL_DELAY_SEC) -> Column:
    return sec <= SECONDS_PER_DAY - delay_sec
