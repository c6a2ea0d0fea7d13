"""Structured Streaming forms of the slot counts."""
