"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``conversations``.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one
query per operator, ``oracle.py`` holds the DuckDB SQL where SQL can express one.
"""
