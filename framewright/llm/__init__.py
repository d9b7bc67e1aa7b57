"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator takes DataFrames and
names of columns, reads only those columns, and returns a new DataFrame, so
further columns of the input can have any name.
"""
