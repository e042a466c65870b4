"""Structured Streaming monitors over append-only run logs."""
