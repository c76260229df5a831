"""Structured Streaming jobs over arriving results and events."""
