"""Operators of a training-data pipeline: filters, scores, counts, near duplicates, secrets, mixing.

Nothing else in the library imports this package. Every operator is a function from DataFrames to DataFrames; ``queries`` holds the
registered queries that apply them to whole tables.
"""
