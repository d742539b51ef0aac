"""Operators: functions of DataFrames that give DataFrames."""
