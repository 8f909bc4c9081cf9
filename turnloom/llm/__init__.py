"""Operators that prepare transcript corpora as training data."""
