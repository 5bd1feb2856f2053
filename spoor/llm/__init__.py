"""Operators that prepare training data: sharding, deduplication, scoring, archives, tokens."""
