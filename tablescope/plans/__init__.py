"""Compositions of operators, and the registry of checked queries."""
