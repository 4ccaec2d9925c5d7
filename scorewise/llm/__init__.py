"""Training-data operators: tokenising, de-duplication, quality, sharding, formatting.

Nothing outside this subpackage imports it.
"""
