"""Plumbline: profiling, typing and preparing tabular data on Spark."""
