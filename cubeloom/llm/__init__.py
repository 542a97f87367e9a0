"""Operators for preparing training text at scale.

Nothing else in the package imports this one. Each module holds one operator
with an interface of its own; ``queries`` holds the thin registered queries.
"""
