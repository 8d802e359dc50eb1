"""Scalar functions on dates, text and records, as Column expressions."""
