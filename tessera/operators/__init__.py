"""Operators that take and return DataFrames."""
