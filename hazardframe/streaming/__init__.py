"""Structured Streaming forms of the incremental behaviour."""
