"""Operators of a training-data pipeline, built on Spark DataFrames.

Nothing outside this package imports it.  Every operator is a function from DataFrames to a DataFrame;
the contract queries and their SQL are in :mod:`playlake.llm.queries`.
"""
