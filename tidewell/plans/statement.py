"""The statement of a query, and its parsing from four strings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from tidewell.errors import BadRequest
from tidewell.functions.aggregates import AGGREGATES

GROUP_BY_MS = {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
LEAST_TS, MOST_TS = -(2**63), 2**63 - 1
DATE = re.compile(r"([+-]?\d{4,6})-(\d\d)-(\d\d)", re.ASCII)
INTEGER = re.compile(r"[+-]?\d+", re.ASCII)


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, for any year."""
    lengths = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if not (1 <= month <= 12 and 1 <= day <= lengths[month - 1]):
        raise BadRequest(f"no such date: {year}-{month}-{day}")
    before = year - 1
    return 365 * before + before // 4 - before // 100 + before // 400 + sum(lengths[: month - 1]) + day - 719_163


def parse_from(text: str) -> int:
    """A date, taken as midnight UTC, or epoch milliseconds."""
    if found := DATE.fullmatch(text):
        ts = days_from_civil(*map(int, found.groups())) * GROUP_BY_MS["day"]
    elif INTEGER.fullmatch(text):
        ts = int(text)
    else:
        raise BadRequest(f"from: {text!r} is neither a date nor milliseconds")
    if not LEAST_TS <= ts <= MOST_TS:
        raise BadRequest("from is out of range")
    return ts


@dataclass(frozen=True)
class Statement:
    """From a time on, the aggregates of each bucket, earliest first, of the first limit buckets that have entries."""

    from_ts: int
    group_by_ms: int
    aggregators: tuple[str, ...]
    limit: int

    @classmethod
    def parse(cls, from_: str | None, group_by: str | None, aggregators: str | None, limit: str | None) -> Statement:
        """All four are needed; order and repeats of aggregators are kept. BadRequest otherwise."""
        for name, given in (("from", from_), ("group_by", group_by), ("aggregators", aggregators), ("limit", limit)):
            if given is None:
                raise BadRequest(f"{name} is missing")
        if group_by not in GROUP_BY_MS:
            raise BadRequest(f"group_by: {group_by!r}")
        names = tuple(aggregators.split(","))
        if unknown := [n for n in names if n not in AGGREGATES]:
            raise BadRequest(f"aggregators: {unknown[0]!r}")
        if not re.fullmatch(r"\+?\d+", limit, re.ASCII) or int(limit) >= 2**64:
            raise BadRequest(f"limit: {limit!r}")
        return cls(parse_from(from_), GROUP_BY_MS[group_by], names, int(limit))

    @classmethod
    def of(cls, from_ts: int = LEAST_TS, group_by_ms: int = GROUP_BY_MS["hour"], aggregators: Sequence[str] = ("mean",), limit: int = 1000) -> Statement:
        return cls(from_ts, group_by_ms, tuple(aggregators), limit)
