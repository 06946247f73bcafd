"""Aggregates of a bucket's values, by name."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GREATEST = sys.float_info.max


def _least(v: Column) -> Column:
    """Like min, but NaN counts as nothing, and the result is a finite number at most."""
    return F.least(F.lit(GREATEST), F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(GREATEST)))


def _most(v: Column) -> Column:
    return F.greatest(F.lit(-GREATEST), F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(-GREATEST)))


#: Name in a statement -> expression over the values.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "min": _least, "max": _most}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Add an aggregate that statements can name; build makes an aggregate expression of the value column."""
    if not name or "," in name:
        raise ValueError("the name must not be empty or hold a comma")
    AGGREGATES[name] = build


def result_names(names: Sequence[str]) -> list[str]:
    """mean, min, max, min_2: a repeated aggregate gets a number."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def aggregate_columns(names: Sequence[str], value: str = "value") -> list[Column]:
    """One expression for each name, in order; Spark computes repeated ones once."""
    return [AGGREGATES[n](F.col(value)).alias(alias) for n, alias in zip(names, result_names(names), strict=True)]
