"""Streams of entries into stored series."""

from tidewell.streaming.sink import append_stream

__all__ = ["append_stream"]
