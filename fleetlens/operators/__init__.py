"""Operators: functions from DataFrames (plus an explicit as_of) to DataFrames."""
