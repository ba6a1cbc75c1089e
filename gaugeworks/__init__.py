"""Experiment analytics and dataset construction on Spark DataFrames."""
