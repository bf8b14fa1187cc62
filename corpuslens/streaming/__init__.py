"""Structured Streaming operators on event streams."""
