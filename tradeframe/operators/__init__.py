"""The operators: functions from DataFrames to DataFrames."""
