"""Structured Streaming forms of the per-document operators."""
