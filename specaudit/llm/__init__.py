"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; :mod:`specaudit.llm.queries` registers one thin query
for each of them.
"""
