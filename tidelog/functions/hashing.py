"""Hash expressions that any engine with md5 can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(text: Column, hex_digits: int = 8) -> Column:
    """Leading hex digits of md5 as a non-negative long (at most 15 digits)."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def md5_tail_mod(text: Column, modulus: int) -> Column:
    """md5 read as a 128-bit integer, modulo a power of two below 2^60."""
    if modulus & (modulus - 1) or modulus > 2 ** 60:
        raise ValueError("modulus must be a power of two up to 2^60")
    return F.conv(F.substring(F.md5(text), 18, 15), 16, 10).cast("long") % modulus


def token(column: str, value: Column) -> Column:
    return F.concat(F.lit(column + "="), value.cast("string"))


def in_sample(seed: Column, row_id: Column, fraction: float) -> Column:
    """Deterministic uniform sample: same rows on every run and every engine."""
    key = F.concat_ws(":", seed.cast("string"), row_id.cast("string"))
    return md5_int(key) < F.lit(int(fraction * 2 ** 32))
