"""Importing this module registers every query."""

from workload import ingest_queries, model_queries, series_queries, skill_queries  # noqa: F401
