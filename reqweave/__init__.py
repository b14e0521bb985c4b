"""Structured generation over DataFrames: requests out, checked answers back."""
