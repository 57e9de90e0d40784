"""Operators for preparing training text: ten numbered ones, their queries and their SQL.

Nothing else in the library imports this package.
"""
