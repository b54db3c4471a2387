"""Operators over log DataFrames."""
