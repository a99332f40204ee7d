"""Operators for preparing training data: quality, deduplication, contamination, licences, sharding, tokens."""
