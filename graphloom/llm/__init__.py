"""Operators for training data.  Optional: nothing outside imports this package."""
