"""Cohort, time-series, text and model-evaluation analytics on Spark DataFrames."""
