"""Operators over DataFrames of entries (ts long, value double)."""

from tidewell.operators.ingest import block_index, chunked, first_block_at, late_filter, late_filter_batches, numbered, running_max
from tidewell.operators.query import counted, json_document, run, scan, tagged_rows

__all__ = ["block_index", "chunked", "counted", "first_block_at", "json_document", "late_filter", "late_filter_batches", "numbered", "run", "running_max", "scan", "tagged_rows"]
