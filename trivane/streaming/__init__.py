"""Structured Streaming forms of the write log."""
