"""Operators that prepare training text: each takes DataFrames and gives DataFrames.

Nothing outside this package imports it.
"""
