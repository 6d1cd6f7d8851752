"""Training-data operators (tokens, deduplication, quality, packing, formatting).

Nothing else in the library imports this subpackage.
"""
