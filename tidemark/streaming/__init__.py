"""Structured Streaming forms of the signal engine."""
