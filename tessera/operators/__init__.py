"""Operators: reading, aggregating and writing objects."""
