"""Structured Streaming versions of the session-like operators."""
