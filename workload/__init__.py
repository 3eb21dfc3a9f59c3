"""Checked queries: every operator over the given tables, beside the same query in SQL."""
