"""Structured Streaming over the event tables."""
