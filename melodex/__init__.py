"""Melodic time-series analytics on Spark."""
