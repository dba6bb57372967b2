"""Scalar functions and closed-form statistics as column expressions."""
