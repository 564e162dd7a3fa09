"""Training-data operators: fingerprints, tokenizing, search, joins, filters, archives, sharding, packing.

Nothing else in the library imports this package; ``queries`` holds the
registered queries.
"""
