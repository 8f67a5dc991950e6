"""Operators for large training-data pipelines: one module per operator.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, selects the columns it needs first (so extra columns, whatever
their names, never clash) and returns a DataFrame; ``queries`` derives the
digest columns of the registered ``opN_*`` queries from those results.
"""
