"""Scalar operations on token arrays (columns) and exact verifiers (plain functions)."""
