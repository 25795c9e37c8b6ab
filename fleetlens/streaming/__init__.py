"""Structured Streaming versions of the polled operators."""
