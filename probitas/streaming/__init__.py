"""Incremental ingest of responses."""
