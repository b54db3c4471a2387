"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns
DataFrames; queries over the test tables are in :mod:`tidelog.llm.queries`.
"""
