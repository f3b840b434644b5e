"""Operators that prepare training text, each a DataFrame to DataFrame function."""
