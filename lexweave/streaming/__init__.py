"""Joins of a stream of records against a static table."""
