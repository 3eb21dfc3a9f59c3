"""Incremental ingest of raw measurement files."""
