"""Operators for building training corpora at scale.

Nothing outside this package imports it.  Every operator is a function from
DataFrame to DataFrame; ``queries.py`` applies each of them to its table.
"""
