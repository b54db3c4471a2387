"""Partitioned, offset-addressed message logs as Spark DataFrames and streaming queries."""
