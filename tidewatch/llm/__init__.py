"""Operators for large-scale training-data pipelines.

The subpackage stands alone: nothing else in the library imports it.  Every operator is a function from DataFrames to
DataFrames; :mod:`tidewatch.llm.queries` binds them to the tables of a data folder.
"""
