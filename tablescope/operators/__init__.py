"""Audit operators: DataFrame in, flat DataFrame out."""
