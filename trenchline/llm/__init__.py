"""Operators that prepare training text: deduplication, filters, mixing, tokens and search.

Nothing else in the library imports this subpackage.
"""
