"""Entries as lines of text: `ts; value` with two decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS = r"^[+-]?\d+$"
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def fixed2(value: Column) -> Column:
    """Two decimals, ties of the exact binary value to even: 1.005 gives 1.00, 0.125 gives 0.12.

    From 2**53 on Java's shortest digits are filled up with zeros.
    """
    special = F.when(F.isnan(value), "NaN").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return special.otherwise(F.call_function("format_number", value, F.lit("0.00")))


def line_of(ts: Column, value: Column) -> Column:
    return F.concat(ts.cast("string"), F.lit("; "), fixed2(value))


def _field(line: Column, k: int) -> Column:
    return F.regexp_replace(F.get(F.split(line, ";"), F.lit(k)), r"^\s+|\s+$", "")


def parsed_line(line: Column) -> Column:
    """A struct (ts, value) of the first two fields; null unless both are numbers. Further fields are ignored."""
    ts, value = _field(line, 0), _field(line, 1)
    parsed_ts = F.when(ts.rlike(TS), ts.try_cast("long"))
    parsed_value = F.when(value.rlike(NUMBER), value.try_cast("double"))
    return F.when(parsed_ts.isNotNull() & parsed_value.isNotNull(), F.struct(parsed_ts.alias("ts"), parsed_value.alias("value")))
