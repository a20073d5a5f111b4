"""Operators for preparing training text, built on DataFrames.

Nothing else in the library imports this subpackage.
"""
