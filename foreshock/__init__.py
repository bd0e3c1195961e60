"""Forecasting of rare events from sensor series, on PySpark DataFrames."""
