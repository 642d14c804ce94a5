"""Passenger-flow analytics and short-horizon forecasting on Spark DataFrames."""
