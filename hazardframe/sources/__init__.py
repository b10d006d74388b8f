"""Readers of incident reports, manifests, text and web pages, and the sinks."""
