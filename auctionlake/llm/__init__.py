"""Training-data operators: tokenisation, quality, deduplication, decontamination, sharding, formatting.

Nothing outside this subpackage imports it.
"""
