"""Disturbance, response and recovery analysis on panel time series, built from Spark DataFrames."""
