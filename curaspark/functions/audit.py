"""Exact lower confidence bound of an audited share (one-sided, by the binomial tail)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def upper_tail(successes: int, trials: int, p: float) -> float:
    """P(X >= successes) for X of ``trials`` draws with probability p."""
    if successes <= 0:
        return 1.0
    if p <= 0.0:
        return 0.0
    if p >= 1.0:
        return 1.0
    ways = lambda k: math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1)
    return min(1.0, math.fsum(math.exp(ways(k) + k * math.log(p) + (trials - k) * math.log1p(-p)) for k in range(successes, trials + 1)))


def lower_bound(successes: int, trials: int, confidence: float = 0.95) -> float:
    if trials <= 0 or not 0 <= successes <= trials or not 0.0 < confidence < 1.0:
        raise ValueError("counts or confidence out of range")
    if successes == 0:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        if upper_tail(successes, trials, middle) > 1.0 - confidence:
            high = middle
        else:
            low = middle
    return low


def bound_column(successes, trials, confidence: float = 0.95):
    """The bound of each row of counts."""

    @F.pandas_udf("double")
    def run(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([lower_bound(int(a), int(b), confidence) for a, b in zip(k, n, strict=True)])

    return run(successes, trials)


def accepted(successes: int, trials: int, target: float, confidence: float = 0.95) -> bool:
    """Whether the bound is above the target (not at it)."""
    return lower_bound(successes, trials, confidence) > target
