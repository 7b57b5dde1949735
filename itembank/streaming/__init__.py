"""Structured Streaming forms of the progress, usage and ingest operators."""
