"""Time buckets over epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(ts: Column, width_ms: int) -> Column:
    """The greatest multiple of width_ms that is at most ts, also before 1970; ts itself where that lies outside of 64 bits."""
    return F.coalesce(F.try_subtract(ts, F.pmod(ts, F.lit(width_ms).cast("long"))), ts)


def rfc3339(ts: Column) -> Column:
    """2019-08-18T20:00:00+00:00, with milliseconds if there are any; needs UTC as the session's time zone.

    Null where Spark's timestamps can't hold the time.
    """
    inside = ts.between(-62_135_596_800_000, 253_402_300_799_999)
    at = F.timestamp_millis(F.when(inside, ts))
    whole, parts = "yyyy-MM-dd'T'HH:mm:ssxxx", "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"
    return F.when(F.pmod(ts, F.lit(1000)) == 0, F.date_format(at, whole)).otherwise(F.date_format(at, parts))
