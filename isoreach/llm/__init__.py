"""Operators on training-data tables. Nothing outside this package imports it."""
