"""Relational operators: joins, metrics, windows, models, diffs, assertions."""
