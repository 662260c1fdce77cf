"""Operators on DataFrames: layout, reliability, reconciliation, review log, validation."""
