"""Operators: functions from DataFrames (or fitted models) to DataFrames."""
