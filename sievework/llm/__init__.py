"""Training-data operators: sharding, scoring, tokenising, packing, near-duplicate search.

Nothing else in the library imports this subpackage, so it can be removed whole.
"""
