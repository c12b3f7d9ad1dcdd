"""Excess-vocabulary analytics on Spark DataFrames."""
