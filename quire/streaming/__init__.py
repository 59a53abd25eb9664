"""Ingest as a stream."""
