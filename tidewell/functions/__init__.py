"""Column functions: time buckets, aggregates, text forms of entries."""

from tidewell.functions.aggregates import AGGREGATES, aggregate_columns, register_aggregate
from tidewell.functions.buckets import bucket, rfc3339
from tidewell.functions.lines import fixed2, line_of, parsed_line

__all__ = ["AGGREGATES", "aggregate_columns", "bucket", "fixed2", "line_of", "parsed_line", "register_aggregate", "rfc3339"]
