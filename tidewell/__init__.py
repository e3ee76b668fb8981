"""Tidewell: time-series and log analytics on PySpark DataFrames."""
