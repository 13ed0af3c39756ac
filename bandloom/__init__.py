"""Predictive quantile bands over calendar series, planned as Spark DataFrames."""
