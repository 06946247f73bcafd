import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewell.errors import BadRequest
from tidewell.plans.statement import Statement, days_from_civil, parse_from


def test_order_and_repeats_are_kept():
    assert Statement.parse("10", "hour", "mean,min,max,min", "1000") == Statement(10, 3_600_000, ("mean", "min", "max", "min"), 1000)


@pytest.mark.parametrize(("group_by", "width"), [("minute", 60_000), ("hour", 3_600_000), ("day", 86_400_000)])
def test_widths(group_by, width):
    assert Statement.parse("0", group_by, "max", "0").group_by_ms == width


@pytest.mark.parametrize(
    "given_",
    [
        ("10", "milli", "mean", "1"), ("10", "Hour", "mean", "1"), ("10", "hour", "", "1"), ("10", "hour", "mean, min", "1"), ("10", "hour", "Mean", "1"),
        ("10", "hour", "mean", "-1"), ("10", "hour", "mean", "1.5"), ("10", "hour", "mean", str(2**64)), ("2019-08-18 10:00", "hour", "mean", "1"), ("2019-02-29", "hour", "mean", "1"),
        ("x", "hour", "mean", "1"), (str(2**63), "hour", "mean", "1"), (None, "hour", "mean", "1"), ("10", "hour", "mean", None),
    ],
)
def test_bad_statements(given_):
    with pytest.raises(BadRequest):
        Statement.parse(*given_)


def test_from():
    assert parse_from("1234") == 1234
    assert parse_from("-5") == -5
    assert parse_from("1970-01-02") == 86_400_000
    assert parse_from("2019-08-18") == 1_566_086_400_000
    assert parse_from("1969-12-31") == -86_400_000
    assert parse_from("-262000-01-01") == days_from_civil(-262000, 1, 1) * 86_400_000 < -8_000_000_000_000_000


@given(st.dates())
def test_days_agree_with_the_standard_library(date):
    assert days_from_civil(date.year, date.month, date.day) == (date - datetime.date(1970, 1, 1)).days
