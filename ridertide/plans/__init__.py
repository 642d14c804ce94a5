"""Whole runs, from counts to scored forecasts."""
