"""Operators for large training-data corpora.

Nothing outside this subpackage imports it. Every operator takes DataFrames,
reads whole texts and returns a DataFrame; ``queries`` registers one query per
operator over the given tables.
"""
