"""Structured Streaming forms of operators that make sense on event streams."""
