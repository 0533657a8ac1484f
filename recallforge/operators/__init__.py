"""Recall and search operators: functions from DataFrames to DataFrames."""
