"""Structured Streaming jobs: ingest, incremental rollups, dedup."""
