"""Operators of a training-data pipeline over ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``registry`` holds the thin queries and their SQL.
"""
