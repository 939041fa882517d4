"""Training-data operators: sharding, near-duplicates, PII, packing, mixing, quality, fingerprints.

Nothing else in the library imports this subpackage.
"""
