"""Readers and writers of records, rules, pair files, results and statistics."""
