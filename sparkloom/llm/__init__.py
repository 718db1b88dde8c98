"""Operators of a training-data pipeline: mixing, filtering, deduplication, sharding, packing, search.

Nothing outside this subpackage imports it; it imports nothing of the rest of the library.
"""
