"""Tidewell: append-only time series and analytics on Spark DataFrames."""
