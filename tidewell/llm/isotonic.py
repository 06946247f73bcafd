"""Isotonic calibration: a rising step function from raw scores to probabilities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned(df: DataFrame, raw: str, label: str, low: float, high: float, steps: int = 1000) -> list[tuple[float, int, int]]:
    """(raw score, rows, rows of label 1) in at most steps + 1 bins, summed by Spark."""
    width = (high - low) / steps
    at = F.round((F.least(F.greatest(F.col(raw), F.lit(low)), F.lit(high)) - low) / width).cast("int").alias("bin")
    rows = df.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones")).collect()
    return sorted((low + r["bin"] * width, r["n"], int(r["ones"])) for r in rows)


def fit(bins: Sequence[tuple[float, float, float]], strength: float = 1.0) -> tuple[list[float], list[float]]:
    """Knots (raw scores, probabilities) by pooling adjacent violators; each pool is drawn to the overall rate by strength rows.

    Without rows the probability is one half everywhere.
    """
    n, ones = sum(b[1] for b in bins), sum(b[2] for b in bins)
    rate = (ones + 0.5) / (n + 1)
    pools: list[list[float]] = []  # lowest raw, highest raw, rows, ones
    for raw, rows, hits in bins:
        pools.append([raw, raw, rows, hits])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    x, y = [], []
    for low, high, rows, hits in pools:
        p = (hits + strength * rate) / (rows + strength)
        x += [low, high] if high > low else [low]
        y += [p, p] if high > low else [p]
    return (x, list(np.maximum.accumulate(y))) if x else ([0.0], [rate])


def apply(raw: Column, knots: tuple[list[float], list[float]]) -> Column:
    """The calibrated score, linear between knots, as a Spark expression."""
    x, y = knots
    xs = F.array(*[F.lit(float(v)) for v in x])
    ys = F.array(*[F.lit(float(v)) for v in y])
    # The number of knots at or below the raw score, by bisection: steps of falling powers of two are taken where they don't go too far.
    n = len(x)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def stepped(at: Column, step: Column) -> Column:
        return F.when((at + step <= n) & (F.element_at(xs, F.least(at + step, F.lit(n))) <= raw), at + step).otherwise(at)

    below = F.aggregate(steps, F.lit(0), stepped)
    here, there = F.element_at(ys, F.greatest(below, F.lit(1))), F.element_at(ys, F.least(below + 1, F.lit(len(x))))
    left, right = F.element_at(xs, F.greatest(below, F.lit(1))), F.element_at(xs, F.least(below + 1, F.lit(len(x))))
    inside = (below >= 1) & (below < len(x)) & (right > left)
    return F.when(inside, here + (there - here) * (raw - left) / (right - left)).otherwise(here)
