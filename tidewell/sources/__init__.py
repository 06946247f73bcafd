"""Stored series, and entries as text and JSON."""

from tidewell.sources.catalog import SeriesCatalog, SeriesReader, SeriesWriter
from tidewell.sources.textio import entries_of_json, export_lines, read_lines, restore, write_export

__all__ = ["SeriesCatalog", "SeriesReader", "SeriesWriter", "entries_of_json", "export_lines", "read_lines", "restore", "write_export"]
