"""Operators for preparing training text: counting, cleaning, deduplicating, mixing, packing, sharding."""
