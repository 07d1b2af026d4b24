"""Causal time-series analytics and data-processing operators on PySpark."""
