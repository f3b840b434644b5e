"""Operators over DataFrames: recurrence, islands, windows of tokens, metrics."""
