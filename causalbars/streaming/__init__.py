"""Structured Streaming twins of the windowed operators."""
