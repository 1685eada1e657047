"""Delay analytics on Spark: table operators from DataFrames to DataFrames."""
