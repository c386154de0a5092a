"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator is a function over
DataFrames in a module of its own; ``queries`` registers one query for each.
"""
