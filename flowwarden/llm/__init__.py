"""Operators for preparing training data: search, deduplication, personal data, sharding, archives, mixing, tokens.

Each module holds one operator; ``queries`` applies them to the given tables.
"""
