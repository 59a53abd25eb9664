"""Whole jobs: ingest, storage, queries, answers."""
