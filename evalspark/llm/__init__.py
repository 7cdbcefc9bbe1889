"""Operators for large training-data pipelines (one module per operator)."""
