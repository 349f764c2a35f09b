"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame plus column names and returns a DataFrame with one row per input
row; the thin ``opN_*`` queries and their SQL are in ``queries.py``.
"""
