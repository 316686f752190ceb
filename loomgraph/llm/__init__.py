"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
