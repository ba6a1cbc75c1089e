"""Operators for building language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin queries are in ``queries.py``.
"""
