"""Column expressions for probabilities, losses and decay constants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clips that must agree with the published definitions.
LOSS_CLIP = 1e-12
MIXTURE_LOSS_CLIP = 1e-6
LOGIT_CLIP = 1e-5
SIGMOID_LIMIT = 30.0


def clip(p: Column, eps: float) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))


def logit(p: Column, eps: float = LOGIT_CLIP) -> Column:
    c = clip(p, eps)
    return F.log(c / (1.0 - c))


def sigmoid(z: Column) -> Column:
    bounded = F.greatest(F.least(z, F.lit(SIGMOID_LIMIT)), F.lit(-SIGMOID_LIMIT))
    return 1.0 / (1.0 + F.exp(-bounded))


def log_loss(y: Column, p: Column, eps: float = LOSS_CLIP) -> Column:
    c = clip(p, eps)
    return -(y * F.log(c) + (1 - y) * F.log(1.0 - c))


def tally_loss(n: Column, clicks: Column, p: Column, eps: float = LOSS_CLIP) -> Column:
    """Summed log loss of ``n`` impressions with ``clicks`` clicks that share one prediction."""
    c = clip(p, eps)
    return -(clicks * F.log(c) + (n - clicks) * F.log(1.0 - c))


def tally_brier(n: Column, clicks: Column, p: Column) -> Column:
    return clicks * (1.0 - p) * (1.0 - p) + (n - clicks) * p * p


def phase(t: Column, period: Column) -> tuple[Column, Column]:
    """(sin, cos) of the position in the cycle; (0, 0) while no period is known."""
    angle = 2 * math.pi * t / F.when(period > 0, period)
    return F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))


def keep_per_step(half_life: float) -> float:
    return 2.0 ** (-1.0 / half_life)


def share_rate(block_sec: float, half_life_sec: float) -> float:
    return 0.0 if math.isinf(half_life_sec) else 1.0 - 2.0 ** (-block_sec / half_life_sec)


def age_weight(age: Column, half_life: float | Column) -> Column:
    return F.exp(-math.log(2.0) * age / half_life)
