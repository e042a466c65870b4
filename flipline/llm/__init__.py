"""Operators of a training-data pipeline: filters, deduplication, scans, tokens. Nothing else in the library imports this."""
