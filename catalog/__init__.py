"""Registered queries with the SQL that checks them.

Each module holds ``QUERIES`` (name to function of session and data folder) and
``SQL`` (name to the DuckDB statement with the same result).
"""
