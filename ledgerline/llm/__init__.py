"""Operators that prepare training data: one module for each, on DataFrames in and DataFrames out."""
