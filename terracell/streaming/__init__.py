"""Structured Streaming variants of the gridding aggregates."""
