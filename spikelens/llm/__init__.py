"""Operators that prepare training text: deduplication, packing, filters, sharding, fingerprints, decontamination."""
